"""Corpus noise: observations of short messages, candidate joins by shared signatures, decisions, families, policies; evaluation metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.text import COMPOUND, deletions, folded, is_lengthening, laughter_seed, message_form, one_edit, punctuation_key, repeated_seed, run_key, structural_flags, utc_day, whole_word, words

KEY = ["chat_id", "message_id"]
#: Answers that are kept whatever family they are in.
KEPT = ("да", "нет", "ага")
COMMAND = r"^/[a-z][a-z0-9_]{0,63}(@[a-z0-9_]{1,64})?$"
MOST_TEXT, MOST_WORDS, MOST_CANDIDATES, SHOWN = 16384, 4, 256, 16


def source_rows(messages: DataFrame) -> DataFrame:
    """Live messages with what the analysis asks of them: their text cut off beyond MOST_TEXT, and whether they answer a question."""
    parents = messages.where("deleted = 0").select("chat_id", F.col("message_id").alias("reply_to"), F.col("text").contains("?").alias("_question"))
    joined = messages.where("kind = 'message' and deleted = 0").join(parents, ["chat_id", "reply_to"], "left")
    limited = F.length("text") > MOST_TEXT
    return joined.select(*KEY, F.when(~limited, F.col("text")).alias("text"), limited.alias("limited"), "has_photo", "protected", "bot_command", F.coalesce("_question", F.lit(False)).alias("parent_question"), "author_id", utc_day(F.col("timestamp")).alias("day"))


def observations(rows: DataFrame, seeds: tuple[str, ...], salt: str = "") -> DataFrame:
    """Forms of messages with fewer than five different words, with what protects each, and a salted key of the author.

    rows: what source_rows gives. Approved seeds are not protected by their looks.
    """
    distinct = F.size(F.array_distinct(F.regexp_extract_all(folded(F.col("text")), F.lit(COMPOUND), F.lit(0))))
    short = rows.where(~F.col("limited") & (distinct <= MOST_WORDS)).withColumns({"form": message_form(F.col("text")), "is_word": whole_word(F.col("text")).isNotNull()}).where("form is not null")
    looks = F.concat(structural_flags(F.col("text"), F.col("form")), F.array_compact(F.array(F.when(F.col("form").rlike("[-'’]"), "compound_term"))))
    looks = F.when(F.col("is_word") & ~F.col("form").isin(*seeds), looks).otherwise(F.array().cast("array<string>"))
    flags = F.array_compact(F.array(F.when(F.col("has_photo") == 1, "attachment"), F.when(F.col("protected") == 1, "structured_entity"), F.when(F.col("parent_question"), "question_reply")))
    found = short.withColumns({"protections": F.concat(flags, looks), "author_key": F.sha2(F.concat(F.lit(salt + "\0"), F.coalesce("author_id", F.lit(""))), 256)})
    return found.select(*KEY, "form", "is_word", (F.size("protections") == 0).alias("eligible"), "protections", "day", "author_key", (F.col("bot_command") == 1).alias("bot"))


def form_statistics(seen: DataFrame) -> DataFrame:
    """Per form: uses, eligible ones, days, eligible days, authors and bot commands."""
    return seen.groupBy("form").agg(
        F.first("is_word").alias("is_word"), F.count(F.lit(1)).alias("n"), F.count_if("eligible").alias("n_eligible"), F.countDistinct("day").alias("n_days"),
        F.countDistinct(F.when(F.col("eligible"), F.col("day"))).alias("n_eligible_days"), F.countDistinct("author_key").alias("n_authors"), F.count_if("bot").alias("n_bot"),
    )


def protections(seen: DataFrame) -> DataFrame:
    """Per form and kind of protection how often it holds."""
    return seen.select("form", F.explode("protections").alias("protection")).groupBy("form", "protection").agg(F.count(F.lit(1)).alias("n"))


def phrase_words(rows: DataFrame) -> DataFrame:
    """Words of short messages of several words, with their uses."""
    found = F.regexp_extract_all(folded(F.col("text")), F.lit(COMPOUND), F.lit(0))
    short = rows.where(~F.col("limited") & (F.col("protected") == 0) & F.btrim("text").rlike(r"\s") & whole_word(F.col("text")).isNull() & (F.size(F.array_distinct(found)) <= MOST_WORDS))
    return short.select(F.explode(found).alias("word")).where(F.length("word") <= 64).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def word_statistics(texts: DataFrame, text: str = "text") -> DataFrame:
    """Per word its occurrences and the rows it stands in: words of all rows and distinct words of each row, in one scan and one shuffle."""
    each = texts.select(words(F.col(text)).alias("_w"))
    marked = lambda found, n, docs: F.transform(found, lambda x: F.struct(x.alias("word"), F.lit(n).alias("n"), F.lit(docs).alias("n_docs")))
    both = each.select(F.explode(F.concat(marked(F.col("_w"), 1, 0), marked(F.array_distinct("_w"), 0, 1))).alias("x"))
    return both.groupBy("x.word").agg(F.sum("x.n").cast("long").alias("n"), F.sum("x.n_docs").cast("long").alias("n_docs"))


def signatures(forms: DataFrame, name: str) -> DataFrame:
    """Each form under itself, itself without each letter, and its run key."""
    keys = F.array_union(F.array(F.concat(F.lit("="), "form")), F.array_union(F.transform(F.when(F.length("form") > 0, deletions(F.col("form"))), lambda x: F.concat(F.lit("="), x)), F.array(F.concat(F.lit("~"), run_key(F.col("form"))))))
    return forms.select("form", F.explode(keys).alias("signature")).withColumnRenamed("form", name)


def met(forms: DataFrame, seeds: DataFrame) -> DataFrame:
    """Pairs of a form and a seed that share a signature."""
    own = signatures(forms.select("form").distinct(), "form").where("form is not null")
    return own.join(signatures(seeds.select("form").distinct(), "seed"), "signature").select("form", "seed").distinct()


def candidates(forms: DataFrame, seeds: DataFrame, most: int = MOST_CANDIDATES) -> DataFrame:
    """For each form the seeds one edit away (or equal to it, or lengthened by it), with the edit: the first most in the order of seeds, and whether there were more."""
    edit = F.coalesce(one_edit(F.col("seed"), F.col("form")), F.when(is_lengthening(F.col("form"), F.col("seed")), "lengthening"))
    fits = met(forms, seeds).withColumn("edit", edit).where("edit is not null")
    # tested first, then numbered: what shares a signature and is no edit takes nobody's place
    placed = fits.withColumns({"_rn": F.row_number().over(W.partitionBy("form").orderBy("seed")), "incomplete": F.count(F.lit(1)).over(W.partitionBy("form")) > most})
    return placed.where(F.col("_rn") <= most).select("form", "seed", "edit", "incomplete")


def lengthened(forms: DataFrame, seeds: DataFrame) -> DataFrame:
    """Forms that are a seed with letters repeated."""
    a = forms.select("form", run_key(F.col("form")).alias("k"))
    b = seeds.select(F.col("form").alias("seed"), run_key(F.col("form")).alias("k"))
    return a.join(b, "k").where(is_lengthening(F.col("form"), F.col("seed"))).select("form", "seed")


def hypotheses(forms: DataFrame, seeds: tuple[str, ...], most: int = MOST_CANDIDATES) -> DataFrame:
    """What noise a form may stand for: seeds by edit, by repetition of a block and by laughing."""
    spark = forms.sparkSession
    listed = spark.createDataFrame([(x,) for x in seeds], "form string")
    near = candidates(forms, listed, most)
    block, laugh = repeated_seed(F.col("form")), laughter_seed(F.col("form"), seeds)
    other = forms.select("form", F.explode(F.array_compact(F.array(F.when(block.isin(*seeds), F.struct(block.alias("seed"), F.lit("repeated_block").alias("edit"))), F.when(laugh.isNotNull(), F.struct(laugh.alias("seed"), F.lit("laughter_pattern").alias("edit")))))).alias("x")).select("form", "x.*")
    fresh = other.dropDuplicates(["form", "seed"]).join(near, ["form", "seed"], "left_anti").withColumn("incomplete", F.lit(False))
    return near.unionByName(fresh)


def decisions(statistics: DataFrame, seeds: tuple[str, ...], lexicon: DataFrame, most: int = MOST_CANDIDATES) -> DataFrame:
    """omit, review or keep for each whole word, with the reason, the best seed and the margin by which its score beats what else the form may be.

    statistics: form, n and n_eligible, over forms of single words and their corpus frequencies. Scores are log1p of a form's frequency.
    lexicon: useful words (form).
    """
    frequency = statistics.select(F.col("form").alias("seed"), F.col("n").alias("_n"))
    scored = lambda df: df.join(frequency, "seed", "left").withColumn("score", F.log1p(F.coalesce("_n", F.lit(0))))
    noise = scored(hypotheses(statistics.select("form"), seeds, most)).groupBy("form").agg(F.min_by("seed", F.struct((-F.col("score")).alias("a"), F.col("seed").alias("b"))).alias("best_seed"), F.max("score").alias("noise_score"), F.count(F.lit(1)).alias("n_noise"), F.max("incomplete").alias("_cut"))
    useful = scored(candidates(statistics.select("form"), lexicon, most)).groupBy("form").agg(F.max("score").alias("useful_score"), F.max("incomplete").alias("_cut2"), F.max(F.col("edit") == "exact").alias("known"))
    both = statistics.join(noise, "form", "left").join(useful, "form", "left")
    cut = F.coalesce("_cut", F.lit(False)) | F.coalesce("_cut2", F.lit(False))
    reason = (
        F.when(F.col("n_eligible") == 0, "protected_only").when(F.col("form").isin(*seeds), "approved_seed").when(F.coalesce("known", F.lit(False)), "lexicon_form").when(F.length("form") < 3, "short_new_form")
        .when(cut, "candidate_limit").when(F.col("n_noise").isNull(), "no_noise_hypothesis").otherwise("uncalibrated")
    )
    decision = F.when(reason == "approved_seed", "omit").when(reason.isin("candidate_limit", "uncalibrated"), "review").otherwise("keep")
    margin = F.col("noise_score") - F.greatest(F.log1p("n"), F.coalesce("useful_score", F.lit(0.0)))
    return both.select("form", "n", decision.alias("decision"), reason.alias("reason"), "best_seed", F.round(margin, 6).alias("margin"))


def leaders(statistics: DataFrame, least: int = 3, most: int = 2000) -> DataFrame:
    """The most frequent phrases, with at least least uses: other phrases may be variants of these."""
    return statistics.where(~F.col("is_word") & (F.col("n") >= least)).orderBy(F.col("n").desc(), "form").limit(most)


def families(statistics: DataFrame, approved: tuple[str, ...] = (), ratio: int = 3) -> DataFrame:
    """form, seed and operation of every phrase: the leader it is a variant of.

    A leader fits by one edit, by longer runs or by punctuation at its edges, and counts if it is the form itself, approved, the same
    but for punctuation, or ratio times as frequent. Approved ones come first, then the anchor of those that differ in punctuation
    alone (the bare form, else the most frequent), then by frequency.
    """
    spark = statistics.sparkSession
    phrases = statistics.where(~F.col("is_word")).select("form", "n")
    known = spark.createDataFrame([(x, 0) for x in approved], "form string, n long")
    lead = leaders(statistics).select("form", "n").join(known.select("form"), "form", "left_anti").union(known)
    lead = lead.withColumn("p", punctuation_key(F.col("form")))
    frequent = statistics.select(F.col("form").alias("seed"), F.col("n").alias("_f"))
    own = phrases.withColumn("p", punctuation_key(F.col("form")))
    by_punctuation = own.join(lead.select(F.col("form").alias("seed"), "p"), "p").select("form", "seed")
    pool = met(phrases, lead).union(by_punctuation).distinct()
    sides = pool.join(own, "form").join(lead.select(F.col("form").alias("seed"), F.col("n").alias("_n"), F.col("p").alias("_p")), "seed").join(frequent, "seed", "left")
    same = F.col("p") == F.col("_p")
    edit = F.coalesce(one_edit(F.col("seed"), F.col("form")), F.when(is_lengthening(F.col("form"), F.col("seed")), "lengthening"), F.when(same, "edge_punctuation"))
    fits = (F.col("seed") == F.col("form")) | F.col("seed").isin(*approved) | same | (F.col("_n") >= ratio * F.col("n"))
    found = sides.withColumn("operation", edit).where(F.col("operation").isNotNull() & fits)
    group = lead.groupBy("p").agg(F.min_by("form", F.struct((F.col("form") != F.col("p")).alias("a"), (-F.col("n")).alias("b"), F.col("form").alias("c"))).alias("anchor"), F.count(F.lit(1)).alias("_size"))
    found = found.join(group, "p", "left").withColumn("anchor", F.when((F.col("_size") > 1) | (F.col("p") != F.col("form")), F.col("anchor")))
    order = F.struct((~F.col("seed").isin(*approved)).alias("a"), F.coalesce(F.col("seed") != F.col("anchor"), F.lit(True)).alias("b"), (-F.coalesce("_f", F.lit(0))).alias("c"), F.col("seed").alias("d"))
    return found.groupBy("form").agg(F.min_by(F.struct("seed", "operation"), order).alias("x")).select("form", "x.*")


def automatic(statistics: DataFrame, family: DataFrame, approved: tuple[str, ...], lexicon: DataFrame) -> DataFrame:
    """The conservative reason to omit each phrase without being asked, or null.

    approved_message_seed: approved as it is. confirmed_message_family: a transposition or lengthening within one long word of an
    approved phrase, unknown to the lexicon, used three times on two days. structured_bot_command: always a command entity, used ten times on two days.
    """
    pieces = lambda c: F.split(c, " ")
    changed = F.filter(F.zip_with(pieces(F.col("form")), pieces(F.col("seed")), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda x: x["a"] != x["b"])
    both = statistics.where(~F.col("is_word")).join(family, "form", "left").withColumn("_changed", changed)
    both = both.withColumn("_word", F.get("_changed", F.lit(0))["a"]).join(lexicon.select(F.col("form").alias("_word"), F.lit(True).alias("_useful")).distinct(), "_word", "left")
    letters = lambda c: c.rlike(r"^\p{L}{4,}$")
    a, b = F.get("_changed", F.lit(0))["a"], F.get("_changed", F.lit(0))["b"]
    edges = (F.substring(a, 1, 1) == F.substring(b, 1, 1)) & (F.substring(a, -1, 1) == F.substring(b, -1, 1))
    typo = (F.size(pieces(F.col("form"))) == F.size(pieces(F.col("seed")))) & (F.size("_changed") == 1) & letters(a) & letters(b) & edges & F.col("_useful").isNull() & F.col("operation").isin("transposition", "lengthening")
    confirmed = F.col("seed").isin(*approved) & typo & (F.col("n_eligible") >= 3) & (F.col("n_eligible_days") >= 2)
    command = F.col("form").rlike(COMMAND) & (F.col("n_eligible") >= 10) & (F.col("n_eligible_days") >= 2) & (F.col("n_bot") == F.col("n"))
    reason = F.when(F.col("n_eligible") <= 0, None).when(F.col("form").isin(*approved), "approved_message_seed").when(F.coalesce(confirmed, F.lit(False)), "confirmed_message_family").when(command, "structured_bot_command")
    return both.select("form", "n", "n_eligible", "seed", "operation", reason.alias("reason"))


def family_default(form: Column, seed: Column) -> Column:
    """keep for a family of plain answers, else omit; null without a family."""
    kept = run_key(punctuation_key(form)).isin(*KEPT) | run_key(punctuation_key(seed)).isin(*KEPT)
    return F.when(seed.isNotNull(), F.when(kept, "keep").otherwise("omit"))


def roll_up(found: DataFrame) -> DataFrame:
    """By seed: forms, uses, eligible uses, and uses by decision. found: form, seed, n, n_eligible, decision."""
    by = lambda d: F.coalesce(F.sum(F.when(F.col("decision") == d, F.col("n"))), F.lit(0)).alias(d)
    return found.where("seed is not null").groupBy("seed").agg(F.count(F.lit(1)).alias("forms"), F.sum("n").alias("observed"), F.sum("n_eligible").alias("eligible"), by("omit"), by("review"), by("keep"))


def page(rows: DataFrame, *order: Column, offset: int = 0, limit: int = 20) -> DataFrame:
    """One page of rows with has_more: whether rows follow it. One row more than the page is read."""
    some = rows.orderBy(*order).offset(offset).limit(limit + 1)
    more = some.agg((F.count(F.lit(1)) > limit).alias("has_more"))
    return some.orderBy(*order).limit(limit).join(F.broadcast(more), F.lit(True))


def compiled(statistics: DataFrame, explicit: DataFrame, inherited: DataFrame, family: DataFrame, analysis: DataFrame) -> DataFrame:
    """The decision for each form and where it comes from: what was said of the form itself, then of an earlier policy, of its family, of the analysis.

    explicit, inherited and analysis: form and decision; family: form and decision of its family. A review is no decision: such forms stay.
    """
    out = statistics.select("form")
    for name, rows in (("explicit", explicit), ("inherited", inherited), ("family", family), ("analysis", analysis)):
        out = out.join(rows.select("form", F.col("decision").alias(name)), "form", "left")
    settled = [F.when(F.col(x).isin("omit", "keep"), F.struct(F.col(x).alias("decision"), F.lit(x).alias("source"))) for x in ("explicit", "inherited", "family", "analysis")]
    return out.withColumn("x", F.coalesce(*settled, F.struct(F.lit("keep").alias("decision"), F.lit("default").alias("source")))).select("form", "x.*")


def leaks(cases: DataFrame, group: str, split: str) -> DataFrame:
    """Groups that stand in more than one split."""
    return cases.groupBy(group).agg(F.countDistinct(split).alias("splits"), F.count(F.lit(1)).alias("n")).where("splits > 1")


def fence(state: DataFrame, *columns: str) -> Column:
    """What a report rests on, in one value: it is stale once this differs."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256)


def single_words(messages: DataFrame) -> DataFrame:
    """Per whole-word form of an archive (a message counts once, however often it was exported): uses, replies and photos."""
    one = messages.dropDuplicates(KEY).withColumn("form", whole_word(F.col("text"))).where("form is not null and kind = 'message'")
    return one.groupBy("form").agg(F.count(F.lit(1)).alias("n"), F.count("reply_to").alias("n_replies"), F.sum("has_photo").alias("n_photos"))


def chunk_metrics(chunks: DataFrame, size: int = 32) -> DataFrame:
    """By day: chunks, tokens, batches of size in order, the slots they are padded to and how many of these are padding."""
    order = W.partitionBy("chat_id", "day").orderBy("number")
    batched = chunks.withColumn("_batch", F.floor((F.row_number().over(order) - 1) / size)).groupBy("chat_id", "day", "_batch").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t"), F.max("n_tokens").alias("most"))
    sums = batched.groupBy("chat_id", "day").agg(F.sum("n").alias("chunks"), F.sum("t").alias("tokens"), F.count(F.lit(1)).alias("batches"), F.sum(F.col("n") * F.col("most")).alias("slots"))
    return sums.withColumn("padding", F.col("slots") - F.col("tokens"))


#: Limits that an analysis may meet, of its source and of its evidence.
SOURCE_LIMITS = ("message_limit", "form_limit", "phrase_form_limit", "text_limit", "time_limit", "report_size_limit")
EVIDENCE_LIMITS = ("candidate_limit", "payload_limit")


def applicable(reports: DataFrame) -> DataFrame:
    """reports (with limits, those an analysis met) with whether its source and its evidence are whole, and whether its exact rules may be applied: unless a limit is unknown."""
    known = lambda names: F.array(*map(F.lit, names))
    met = F.coalesce("limits", F.array().cast("array<string>"))
    return reports.withColumns({
        "source_complete": F.size(F.array_except(met, known(EVIDENCE_LIMITS))) == 0,
        "evidence_complete": ~F.arrays_overlap(met, known(EVIDENCE_LIMITS)),
        "applicable": F.size(F.array_except(met, known((*SOURCE_LIMITS, *EVIDENCE_LIMITS)))) == 0,
    })


def owned(chunks: DataFrame, role: str | None = None) -> DataFrame:
    """policy, chat_id and message_id of what chunks own: not what they borrow; of one role, if it is given."""
    part = chunks.select("policy", "chat_id", F.explode("parts").alias("p")).where("p.role <> 'borrowed_context'")
    part = part.where(F.col("p.role") == role) if role else part
    return part.select("policy", "chat_id", F.col("p.message_id").alias("message_id")).distinct()


def dry_run(chunks: DataFrame, role: str | None = None) -> DataFrame:
    """What the chunks of policy 0 own and those of policy 1 don't (removed), and the other way round (restored)."""
    # making chunks is the work: both policies are told apart in one pass over them
    return sides(owned(chunks, role), "chat_id", "message_id").where("_0 <> _1").select("chat_id", "message_id", F.when(F.col("_0"), "removed").otherwise("restored").alias("change"))


def sides(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, and whether policies 0 and 1 have them (_0, _1)."""
    return rows.groupBy(*keys).agg(*(F.coalesce(F.bool_or(F.col("policy") == k), F.lit(False)).alias(f"_{k}") for k in (0, 1)))


def dry_run_totals(chunks: DataFrame) -> DataFrame:
    """By chat for both policies (a, b): chunks, tokens, and core messages owned."""
    core = F.transform(F.filter("parts", lambda p: p["role"] == "core"), lambda p: p["message_id"])
    lean = chunks.select("policy", "chat_id", "n_tokens", F.array_distinct(core).alias("_core"))
    # a row a chunk, without a message, and a row for each core message of it: chunks are made once
    each = lean.select("policy", "chat_id", "n_tokens", F.explode(F.concat(F.array(F.lit(None).cast("long")), "_core")).alias("message_id"))
    side = lambda k, x: F.when(F.col("policy") == k, x)
    by_message = each.groupBy("policy", "chat_id", "message_id").agg(F.count(F.lit(1)).alias("_n"), F.sum("n_tokens").alias("_tokens"))
    lone, names = F.col("message_id").isNull(), ((0, "a"), (1, "b"))
    return by_message.groupBy("chat_id").agg(
        *(f.alias(f"{n}_{c}") for k, c in names for n, f in (("chunks", F.coalesce(F.sum(side(k, F.when(lone, F.col("_n")))), F.lit(0))), ("tokens", F.coalesce(F.sum(side(k, F.when(lone, F.col("_tokens")))), F.lit(0))))),
        *(F.count(side(k, F.col("message_id"))).alias(f"owned_{c}") for k, c in names),
    )


def both_differences(a: DataFrame, b: DataFrame, left: str, right: str) -> DataFrame:
    """Rows of a that b lacks and rows of b that a lacks, with which."""
    keys = a.columns
    return a.distinct().join(b, keys, "left_anti").withColumn("change", F.lit(left)).union(b.select(*keys).distinct().join(a, keys, "left_anti").withColumn("change", F.lit(right)))


def precision(cases: DataFrame) -> DataFrame:
    """Precision, recall and false-positive rate of predicted against label (0/1), null where nothing is to divide by."""
    tp, fp = F.count_if(F.expr("predicted = 1 and label = 1")), F.count_if(F.expr("predicted = 1 and label = 0"))
    fn, tn = F.count_if(F.expr("predicted = 0 and label = 1")), F.count_if(F.expr("predicted = 0 and label = 0"))
    rate = lambda a, b: F.round(a / F.nullif(a + b, F.lit(0)), 6)
    return cases.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"), rate(tp, fp).alias("precision"), rate(tp, fn).alias("recall"), rate(fp, tn).alias("fpr"))


def ranking(results: DataFrame, k: int = 10) -> DataFrame:
    """recall@k and nDCG@k per query; results has query, rank and grade (0 to 3) for all judged documents, rank null if not returned."""
    gain = (F.pow(2.0, F.col("grade")) - 1) / F.log2(F.col("rank") + 1.0)
    best = F.row_number().over(W.partitionBy("query").orderBy(F.col("grade").desc(), "doc_id"))
    ideal = (F.pow(2.0, F.col("grade")) - 1) / F.log2(F.col("best") + 1.0)
    hit = (F.col("grade") > 0) & (F.col("rank") <= k)
    per = results.withColumn("best", best).groupBy("query").agg(
        F.count_if(hit).alias("found"), F.count_if(F.expr("grade > 0")).alias("relevant"), F.sum(F.when(F.col("rank") <= k, gain).otherwise(0.0)).alias("dcg"), F.sum(F.when(F.col("best") <= k, ideal).otherwise(0.0)).alias("idcg")
    )
    zero = F.lit(0)
    return per.select("query", F.round(F.col("found") / F.nullif("relevant", zero), 6).alias("recall"), F.round(F.col("dcg") / F.when(F.col("idcg") > 0, F.col("idcg")), 6).alias("ndcg"))
