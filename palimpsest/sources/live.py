"""Pages of a live source as a stream: validated, normalised and taken in once, whatever overlap they are read with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.exports import part
from palimpsest.streaming.keyed import run

#: Messages that a page repeats of the one before.
OVERLAP = 20
#: Kinds of entities by the names that the live source gives them.
ENTITIES = {"Bold": "bold", "Italic": "italic", "Url": "link", "TextUrl": "text_link", "Mention": "mention", "MentionName": "text_mention", "Hashtag": "hashtag", "BotCommand": "bot_command", "Email": "email", "Phone": "phone_number", "Code": "code", "Pre": "pre"}
MESSAGES = "peer_kind string, peer_id long, message_id long, sent long, edited long, sender string, forwarded_from string, text string, entities array<struct<type:string,start:int,length:int>>, media_kind string, media_id string"


def peer(value: Column) -> Column:
    """A peer as kind:id, null if there is none."""
    return F.concat_ws(":", part(value, "$.kind", "string"), part(value, "$.id", "string"))


def normalised(pages: DataFrame) -> DataFrame:
    """Messages of pages (page, a JSON document with peer, cursor, upper and messages), in the archive's terms. Entity kinds that aren't known stay as they are called.

    A page whose ids don't ascend strictly, or leave (cursor - OVERLAP, upper], is not to be trusted, and fails the read.
    """
    v = pages.select(F.parse_json("page").alias("p"))
    listed = part("p", "$.messages", "array<variant>")
    ids = F.transform(listed, lambda m: part(m, "$.id", "long"))
    ordered = F.forall(F.zip_with(F.slice(ids, 1, F.size(ids) - 1), F.slice(ids, 2, F.size(ids)), lambda a, b: F.coalesce(a < b, F.lit(False))), lambda x: x)
    inside = F.forall(ids, lambda i: F.coalesce((i > part("p", "$.cursor", "long") - OVERLAP) & (i <= part("p", "$.upper", "long")), F.lit(False)))
    fine = listed.isNotNull() & (F.when(F.size(ids) > 1, ordered).otherwise(True)) & inside
    kept = F.when(fine, listed).otherwise(F.raise_error(F.lit("a page is out of order or out of bounds")).cast("array<variant>"))
    each = v.select("p", F.explode(kept).alias("m"))
    m = F.col("m")
    names = F.create_map(*(F.lit(x) for pair in ENTITIES.items() for x in pair))
    entity = lambda e: F.struct(F.coalesce(names[part(e, "$.type", "string")], part(e, "$.type", "string")).alias("type"), part(e, "$.offset", "int").alias("start"), part(e, "$.length", "int").alias("length"))
    origin = F.coalesce(part(m, "$.forward.name", "string"), peer(F.try_variant_get(m, "$.forward.peer", "variant")))
    return each.select(
        part("p", "$.peer.kind", "string").alias("peer_kind"), part("p", "$.peer.id", "long").alias("peer_id"), part(m, "$.id", "long").alias("message_id"), part(m, "$.date", "long").alias("sent"), part(m, "$.edited", "long").alias("edited"),
        F.nullif(peer(F.try_variant_get(m, "$.from", "variant")), F.lit("")).alias("sender"), F.nullif(origin, F.lit("")).alias("forwarded_from"), F.coalesce(part(m, "$.text", "string"), F.lit("")).alias("text"),
        F.transform(F.coalesce(part(m, "$.entities", "array<variant>"), F.array().cast("array<variant>")), entity).alias("entities"), part(m, "$.media.kind", "string").alias("media_kind"),
        # a file is the same whatever its access key is just now
        F.when(part(m, "$.media.id", "string").isNotNull(), F.sha2(F.concat_ws(":", part(m, "$.media.kind", "string"), part(m, "$.media.id", "string")), 256)).alias("media_id"),
    )


def received(spark: SparkSession, path: str, root: str, files_per_batch: int = 100, lines: bool = False) -> DataFrame:
    """All messages of the page files below path, each once; a run goes on where the one before ended (offsets and what was seen lie below root).

    A message is known by its peer, id and the times at which it was sent and edited: what a page repeats of the one before is dropped by the stream's state, an edit is taken in.
    A file is a page, or (lines) holds one in each line: pages are small, and a file apiece costs more than what is in it.
    """
    pages = spark.readStream.schema("value string").option("maxFilesPerTrigger", files_per_batch).option("wholetext", not lines).format("text").load(path).withColumnRenamed("value", "page")
    once = normalised(pages).dropDuplicates(["peer_kind", "peer_id", "message_id", "sent", "edited"])
    return run(spark, once, root, MESSAGES, empty_batches=True)
