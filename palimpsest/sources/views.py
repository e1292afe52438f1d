"""The archive's tables as views over the given Parquet tables, the same in Spark and in SQL.

conversations plays the messages: five conversations are a chat, a turn a minute, with pauses and a midnight in between. Every message keeps its
text. Most turns have a further message half a minute later, a short form, command, link, empty text or one outside plain lower case, so that each rule of the archive has cases.
events is the change feed, documents the recognised texts, embeddings the vectors, pages the stored files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = 1704067200
#: Texts by slot: forms that the archive's rules tell apart.
SPECIAL = (
    "LOL", "lool!", "да", "https://host.example/a b", "/start", "", "Good morning team", "good mornign team", "O'Reilly can't wait", "x2y", "хахаха", "Why is it so?", "gg", "gg gg", "/stop now", "12345", "Лол", "good morning team!",
    "/start", "/start", "Good morning team", "good  morning team", "Good morning team", "zzyzx", "with", "lol", "Good morning team", "хохма",
    "Straße nach Bonn", "ＡＢＣ price", "ﬁnal report", "cafe\u0301 au lait",
)
SLOTS = 41


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_PLACE = f"(conv_id * 13 + turn * 7) % {SLOTS}"
_WHEN = f"{EPOCH} + conv_id * 86400 + turn * 60 + CASE WHEN turn >= 4 THEN 5400 ELSE 0 END + CASE WHEN turn >= 6 THEN 86400 ELSE 0 END"
_SPECIAL = f"CASE {_PLACE} " + " ".join(f"WHEN {k} THEN '" + x.replace("'", "''") + "'" for k, x in enumerate(SPECIAL)) + " END"
#: Columns of a message, in words that both dialects have.
_COLUMNS = {
    "chat_id": "CAST(floor(conv_id / 5) AS BIGINT)",
    "message_id": "(conv_id % 5) * 8 + turn",
    "author_id": "CASE WHEN (conv_id + turn) % 13 <> 5 THEN role END",
    "author": "concat(role, CASE WHEN conv_id % 2 = 0 THEN '' ELSE ' II' END)",
    "kind": "CASE WHEN role = 'system' OR (conv_id + 3 * turn) % 17 = 4 THEN 'service' ELSE 'message' END",
    "text": "coalesce(text, '')",
    "timestamp": _WHEN,
    "edited": f"CASE WHEN turn % 2 = 0 THEN {_WHEN} + 10 END",
    "has_photo": "CAST((conv_id + turn) % 5 = 0 AS INT)",
    "protected": "CAST((conv_id + 2 * turn) % 9 = 0 AS INT)",
    "bot_command": "0",
    "deleted": "CAST((conv_id * 7 + turn) % 11 = 0 AS INT)",
    "reply_to": "CASE WHEN turn % 3 = 2 OR (turn % 3 = 1 AND conv_id % 2 = 0) THEN (conv_id % 5) * 8 + turn - 1 WHEN turn = 0 AND conv_id % 5 = 3 THEN 8 END",
    "forwarded_from": "CASE WHEN conv_id % 4 = 1 THEN concat('Feed ', CAST(conv_id % 3 AS STRING)) END",
}


#: What a further message has of its own.
_FURTHER = _COLUMNS | {"message_id": f"{_COLUMNS['message_id']} + 40", "text": _SPECIAL, "timestamp": f"{_WHEN} + 30", "edited": f"CASE WHEN turn % 2 = 0 THEN {_WHEN} + 40 END", "bot_command": f"CAST({_PLACE} IN (4, 18, 19) AS INT)"}


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chat_id, message_id, author_id, author, kind, text, timestamp, edited, has_photo, protected, bot_command, deleted, reply_to, forwarded_from."""
    turns = table(spark, sf_dir, "conversations")
    own = turns.select(*(F.expr(x).alias(name) for name, x in _COLUMNS.items()))
    return own.union(turns.where(f"{_PLACE} < {len(SPECIAL)}").select(*(F.expr(x).alias(name) for name, x in _FURTHER.items())))


def _select_sql(columns: dict[str, str]) -> str:
    return "SELECT " + ", ".join(f"{x} AS {name}" for name, x in columns.items()) + " FROM conversations"


#: The same view for SQL: put before a query.
MESSAGES_SQL = f"messages AS ({_select_sql(_COLUMNS)} UNION ALL {_select_sql(_FURTHER)} WHERE {_PLACE} < {len(SPECIAL)})"


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change feed: chat_id, message_id, ts, kind, value, props."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("chat_id"), F.col("event_id").alias("message_id"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_type").alias("kind"), "value", "props")


FEED_SQL = """feed AS (
  SELECT user_id AS chat_id, event_id AS message_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts, event_type AS kind, value, props FROM events)"""


#: The day of a time in epoch seconds, in words of each dialect.
_DAY = {"spark": "date_format(timestamp_seconds({0}), 'yyyy-MM-dd')", "sql": "strftime(make_timestamp(CAST({0} AS BIGINT) * 1000000), '%Y-%m-%d')"}

#: Further views as steps over messages, by name: each reads the ones before it. {day} is the day of timestamp.
_DERIVED = {
    # three messages of a chat's day are a chunk; what its first message replies to is borrowed
    "placed": """SELECT chat_id, message_id, text, reply_to, {day} AS day, row_number() OVER (PARTITION BY chat_id, {day} ORDER BY timestamp, message_id) - 1 AS place
        FROM messages WHERE kind = 'message'""",
    "owned": """SELECT concat(CAST(chat_id AS STRING), ':', day, ':', CAST(CAST(floor(place / 3) AS BIGINT) AS STRING)) AS chunk_id, chat_id, day, CAST(floor(place / 3) AS BIGINT) AS number,
        message_id, CAST(place % 3 AS BIGINT) AS ordinal, CASE WHEN message_id % 5 = 2 THEN 'support' ELSE 'core' END AS role, length(text) AS chars, reply_to FROM placed""",
    "parts": """SELECT chunk_id, chat_id, day, number, message_id, ordinal, role, chars FROM owned
        UNION ALL SELECT chunk_id, chat_id, day, number, reply_to, CAST(-1 AS BIGINT), 'borrowed_context', 0 FROM owned WHERE ordinal = 0 AND reply_to IS NOT NULL""",
    "segments": """SELECT DISTINCT chat_id, day, 1 + chat_id % 2 AS target_generation, 1 + chat_id % 2 AS chunk_generation,
        1 + chat_id % 2 - CASE WHEN (chat_id + CAST(substr(day, 9, 2) AS INT)) % 7 = 3 THEN 1 ELSE 0 END AS dense_generation FROM owned""",
    "chunks": """SELECT chunk_id, chat_id, day, number, 1 + chat_id % 2 - CASE WHEN number % 3 = 1 THEN 1 ELSE 0 END AS generation, 'space' AS space_id,
        CAST(count(*) * 7 + sum(chars) % 50 AS BIGINT) AS n_tokens, (chat_id * 31 + number * 7 + CAST(substr(day, 9, 2) AS INT)) % 500 AS vec_id FROM owned GROUP BY chunk_id, chat_id, day, number""",
    "work": """SELECT chat_id, day, target_generation AS generation, CASE (chat_id + CAST(substr(day, 9, 2) AS INT)) % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'failed' ELSE 'done' END AS state,
        CASE WHEN (chat_id + CAST(substr(day, 9, 2) AS INT)) % 2 = 0 THEN 'building' ELSE 'embedding' END AS stage FROM segments""",
    # photos refer to recognised texts
    "refs": """SELECT chat_id, message_id, chat_id * 7 + message_id * 3 AS blob_id, CASE WHEN message_id % 4 = 1 THEN 'file' ELSE 'photo' END AS ref_kind,
        CASE WHEN (chat_id + message_id) % 6 = 0 THEN 'missing' ELSE 'ready' END AS status, chat_id * 100 + message_id AS ref_id FROM messages WHERE has_photo = 1""",
}


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the further views: placed, owned, parts, segments, chunks, work or refs."""
    frames = {"messages": messages(spark, sf_dir)}
    for step, text in _DERIVED.items():
        body = text.replace("{day}", _DAY["spark"].format("timestamp"))
        used = {x: f for x, f in frames.items() if f" {x}" in body}
        for x in used:
            body = body.replace(f"FROM {x}", f"FROM {{{x}}}")
        frames[step] = spark.sql(body, **used)
        if step == name:
            return frames[step]
    raise KeyError(name)


#: messages and all further views, for SQL.
ARCHIVE_SQL = ",\n".join([MESSAGES_SQL, *(f"{name} AS ({text.replace('{day}', _DAY['sql'].format('timestamp'))})" for name, text in _DERIVED.items())])
