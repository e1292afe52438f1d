"""Column functions over message texts, and the few that need Python."""

from __future__ import annotations

import json
import re
import unicodedata
import uuid
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

#: Function words of Russian and English queries; negations, numbers and names are kept on purpose.
STOP_WORDS = tuple(
    """
    а б будем будет будут будь будьте бы был была были было быть
    в вам вами вас ваш ваша ваше ваши во вот все всего вы
    где да для до его ее ей ему если есть же за зачем здесь
    и из или им ими их к как ко когда кто ли либо
    мне мной мы на над надо нам нами нас наш наша наше наши
    но ну о об обо от перед по под при про
    с со так также там те тем то того той только том ту ты
    у уж уже чем чего что чтобы эта эти это этот я
    a about above after again against all also am an and any are as at
    be because been before being below between both but by
    can could did do does doing down during each either else
    for from had has have having he her here hers herself him himself his how
    i if in into is it its itself just me more most my myself
    of on once only or other our ours ourselves out over own
    same she should so some such than that the their theirs them themselves
    then there these they this those through to too under until up us very
    was we were what when where which while who whom whose why will with would
    you your yours yourself yourselves
    i'm you're he's she's it's we're they're that's there's here's
    what's who's where's when's why's how's let's
    i've you've we've they've i'll you'll he'll she'll it'll we'll they'll
    i'd you'd he'd she'd we'd they'd
    """.split()
)
WORD = r"[\p{L}\p{N}]+"
#: Words joined by apostrophes, for stop words; by hyphens too, for whole words.
TOKEN = r"[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)*"
COMPOUND = r"[\p{L}\p{N}]+(?:[-'’][\p{L}\p{N}]+)*"
#: Characters that may enclose a whole word, and those that may enclose a phrase.
ENCLOSING = ' \t\n\r.,!?…:;"«»“”()[]'
EDGE = " \t.,!;:()[]{}«»\"'“”„…"
#: Texts of these characters are in NFKC, and lower-casing folds them: ASCII, most of Latin-1, Latin Extended-A's first half, Cyrillic, dashes and quotation marks.
STABLE = r"^[\x00-\x7F«»¿-ÞÀ-Þà-\u012F\u0400-\u0482\u048A-\u052F–—‘-„]*$"
#: Laughing is made of these two letters; seeds in the order in which they are tried.
LAUGHTER = "ах"
LAUGHTER_SEEDS = ("хаха", "ахаха", "ахах", "хах")


def normal(text: str | None) -> str | None:
    """NFKC, then case folding, then ё as е."""
    return None if text is None else unicodedata.normalize("NFKC", text).casefold().replace("ё", "е")


def folded(text: Column) -> Column:
    """normal as a column, in the JVM: lower case where that is all there is to it, else ICU's compatibility composition and full case folding."""
    simple = F.lower(text)
    composed = F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    full = F.call_function("java_method", F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), composed, F.lit(True))
    return F.replace(F.when(text.rlike(STABLE), simple).when(text.isNotNull(), full), F.lit("ё"), F.lit("е"))


def words(text: Column) -> Column:
    return F.regexp_extract_all(folded(text), F.lit(WORD), F.lit(0))


def query_words(query: str, most: int = 100) -> list[str]:
    """Words of a query in order, repeated ones kept."""
    return [x for token in query_tokens(query) for x in re.split("['’]", token)][:most]


def query_tokens(query: str) -> list[str]:
    """Words of a query, those joined by an apostrophe as one."""
    return re.findall(r"[^\W_]+(?:['’][^\W_]+)*", normal(query))


def query_terms(query: str, most: int = 100) -> list[str]:
    """Words of a query without stop words, in order, repeated ones kept. A contraction that is a stop word goes as a whole."""
    kept = [x for x in query_tokens(query) if x.replace("’", "'") not in STOP_WORDS]
    return [x for token in kept for x in re.split("['’]", token)][:most]


def keyword_terms(text: Column) -> Column:
    """query_terms as a column."""
    kept = F.filter(F.regexp_extract_all(folded(text), F.lit(TOKEN), F.lit(0)), lambda x: ~F.replace(x, F.lit("’"), F.lit("'")).isin(*STOP_WORDS))
    return F.flatten(F.transform(kept, lambda x: F.regexp_extract_all(x, F.lit(WORD), F.lit(0))))


def grams(text: Column) -> Column:
    """Distinct hex-encoded 2- and 3-grams of each word."""

    def of(n: int) -> Column:
        long = F.filter(words(text), lambda w: F.length(w) >= n)
        return F.flatten(F.transform(long, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.hex(F.encode(F.substring(w, i, F.lit(n)), "UTF-8")))))

    return F.array_distinct(F.concat(of(2), of(3)))


def run_key(form: Column) -> Column:
    """Every run of a letter as one letter."""
    return F.regexp_replace(form, r"(.)\1+", "$1")


def run_list(form: Column) -> Column:
    """The runs of equal letters of a form."""
    return F.regexp_extract_all(form, F.lit(r"(.)\1*"), F.lit(0))


def is_lengthening(observed: Column, original: Column) -> Column:
    """Whether observed is another form than original, with the same runs of letters, none shorter."""
    longer = F.zip_with(run_list(observed), run_list(original), lambda a, b: F.coalesce((F.substring(a, 1, 1) == F.substring(b, 1, 1)) & (F.length(a) >= F.length(b)), F.lit(False)))
    return (observed != original) & F.forall(longer, lambda x: x)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then of value, which is evaluated once however often then names it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def whole_word(text: Column) -> Column:
    """The single word (hyphens and apostrophes may join its parts) of a text once the punctuation around it is gone, else null."""
    return let(F.btrim(folded(text), F.lit(ENCLOSING)), lambda bare: F.when(bare.rlike(rf"^{COMPOUND}$"), bare))


def phrase_of(text: Column) -> Column:
    """A text with its white space single."""
    return F.btrim(F.regexp_replace(folded(text), r"\s+", " "))


def message_form(text: Column) -> Column:
    """A short message as a form: its whole word (64 characters at most), or its phrase: at most 512 characters before and 256 after
    white space is single, 1 to 32 words, fewer than five different, no link, no control character; one word only as a /command."""

    def phrase(value: Column) -> Column:
        plain = F.length(value).between(1, 256) & ~value.contains("://") & ~value.startswith("www.") & ~value.rlike(r"[\x00-\x1f]")
        counts = lambda found: F.size(found).between(1, 32) & (F.size(F.array_distinct(found)) < 5) & ((F.size(found) > 1) | value.startswith("/"))
        return F.when(plain & let(F.regexp_extract_all(value, F.lit(COMPOUND), F.lit(0)), counts), value)

    form = let(whole_word(text), lambda single: F.when(single.isNotNull(), F.when(F.length(single) <= 64, single)).otherwise(let(phrase_of(text), phrase)))
    return F.when(F.length(text) <= 512, form)


def punctuation_key(form: Column) -> Column:
    """A form without the punctuation at its edges, if what is left is a form."""
    return let(F.btrim(form, F.lit(EDGE)), lambda key: F.when(message_form(key) == key, key).otherwise(form))


def laughter_seed(form: Column, confirmed: tuple[str, ...] = LAUGHTER_SEEDS) -> Column:
    """The first confirmed seed for a form of four or more letters that laughs: only these two letters, no two equal ones in a row."""
    seed = next((x for x in LAUGHTER_SEEDS if x in confirmed), None)
    return F.when((F.length(form) >= 4) & form.rlike(f"^[{LAUGHTER}]+$") & ~form.rlike(r"(.)\1"), F.lit(seed))


def structural_flags(text: Column, form: Column) -> Column:
    """What a form looks like: uppercase, titlecase, number or alphanumeric, mixed_scripts."""
    letters = F.size(F.regexp_extract_all(text, F.lit(r"\p{L}"), F.lit(0)))
    cased = text.rlike(r"\p{Lu}")
    flags = (
        ("uppercase", cased & ~text.rlike(r"\p{Ll}") & (letters >= 2)),
        ("titlecase", cased & ~text.rlike(r"(^|[^\p{L}])\p{Ll}|\p{L}\p{Lu}")),
        ("number", form.rlike(r"^\p{Nd}+$")),
        ("alphanumeric", form.rlike(r"\p{Nd}") & ~form.rlike(r"^\p{Nd}+$")),
        ("mixed_scripts", form.rlike(r"\p{IsLatin}") & form.rlike(r"\p{IsCyrillic}")),
    )
    return F.array_compact(F.array(*(F.when(test, name) for name, test in flags)))


def deletions(form: Column) -> Column:
    """A form with each of its letters left out."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(form)), lambda i: F.concat(F.substring(form, F.lit(1), i - 1), F.substring(form, i + 1, F.length(form)))))


def repeated_seed(form: Column) -> Column:
    """The shortest seed of 1 to 4 letters that a form repeats at least twice, else null."""
    tests = [F.when((F.length(form) >= 2 * k) & (F.length(form) % k == 0) & (F.repeat(F.substring(form, 1, k), (F.length(form) / k).cast("int")) == form), F.substring(form, 1, k)) for k in (1, 2, 3, 4)]
    return F.coalesce(*tests)


def one_edit(a: Column, b: Column) -> Column:
    """How b differs from a by one edit: exact, substitution, transposition, insertion, deletion or null."""
    n, m = F.length(a), F.length(b)
    distance = F.levenshtein(a, b)
    swapped = F.exists(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: (n > 1) & (F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, n)) == b))
    return F.when(a == b, "exact").when((distance == 1) & (n == m), "substitution").when((distance == 1) & (m > n), "insertion").when(distance == 1, "deletion").when((n == m) & (distance == 2) & swapped, "transposition")


def utc_day(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd")


def date_bound(value: Column, end: bool) -> Column:
    """ISO date or time as epoch seconds; a bare day as an end bound includes the day."""
    seconds = F.unix_timestamp(F.to_timestamp(value))
    return seconds + F.when(F.length(value) == 10, 86400).otherwise(0) if end else seconds


def serialize(value: object) -> str:
    """Canonical JSON: sorted keys, no spaces, characters as they are."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


@F.pandas_udf(StringType())
def chat_id(scope: pd.Series, external: pd.Series) -> pd.Series:
    """A chat's id by its scope and external id."""
    return pd.Series([str(uuid.uuid5(uuid.NAMESPACE_URL, f"{a}:{b}")) for a, b in zip(scope, external, strict=True)])


#: Characters of a text that are compared at once, and texts' pieces.
STRETCH, AT_ONCE = 512, 4096


def substring_edits(pattern: str, texts: Sequence[str], most: int) -> np.ndarray:
    """For each text the least edits (an adjacent swap counts as one) between pattern (1 to 64 characters) and any substring of it; -1 beyond most.

    Myers' bit vectors (1999), with Hyyro's term for adjacent swaps (2003): a column of the distance table is where it rises and where it falls. Texts are cut into
    pieces of equal length that overlap by the longest match, and all pieces go on together, a character of each at a time.
    """
    n = len(pattern)
    full, top, one = np.uint64((1 << n) - 1), np.uint64(n - 1), np.uint64(1)
    where = np.zeros(1 << 16, np.uint64)
    rare: dict[int, np.uint64] = {}
    for i, c in enumerate(pattern):
        if ord(c) < len(where):
            where[ord(c)] |= np.uint64(1 << i)
        else:
            rare[ord(c)] = rare.get(ord(c), np.uint64(0)) | np.uint64(1 << i)
    overlap = n + most
    step = max(STRETCH - overlap, overlap)
    codes = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in texts]
    pieces = [(i, k) for i, t in enumerate(codes) for k in range(0, max(1, len(t) - overlap), step)]
    best = np.full(len(texts), n, np.int64)
    for a in range(0, len(pieces), AT_ONCE):
        some = pieces[a : a + AT_ONCE]
        width = max(min(len(codes[i]) - k, step + overlap) for i, k in some)
        block = np.full((width, len(some)), 0xFFFF, np.uint32)  # no character: beyond the end of a piece
        for j, (i, k) in enumerate(some):
            own = codes[i][k : k + step + overlap]
            block[: len(own), j] = own
        zero = np.zeros(len(some), np.uint64)
        rises, falls, diagonal, before = np.full(len(some), full), zero, zero, zero
        score = np.full(len(some), n, np.int64)
        least = score.copy()
        for row in block:
            here = where[np.minimum(row, 0xFFFF)]
            for code, bits in rare.items():
                here = np.where(row == code, bits, here)
            swap = ((~diagonal & here) << one) & before
            diagonal = ((((here & rises) + rises) ^ rises) | here | falls | swap) & full
            up, down = falls | (~(diagonal | rises) & full), diagonal & rises
            score += ((up >> top) & one).astype(np.int64) - ((down >> top) & one).astype(np.int64)
            np.minimum(least, score, out=least)
            up, down = (up << one) & full, (down << one) & full
            rises, falls, before = down | (~(diagonal | up) & full), diagonal & up, here
        np.minimum.at(best, [i for i, _ in some], least)
    return np.where(best <= most, best, -1)


@F.pandas_udf(IntegerType())
def substring_distance(pattern: pd.Series, text: pd.Series, most: pd.Series) -> pd.Series:
    """substring_edits of each row, null beyond most."""
    out = pd.Series([None] * len(pattern), dtype="Int32")
    for (p, m), own in pd.DataFrame({"p": pattern, "m": most, "t": text}).dropna().groupby(["p", "m"]):
        found = substring_edits(p, list(own["t"]), int(m))
        out[own.index] = pd.array([None if x < 0 else int(x) for x in found], dtype="Int32")
    return out
