"""Message memory over whole tables: save, recall, history, context.

Every order inside a session is (ts, seq), newest first (ts desc, seq desc): timestamps have one-second resolution, so
ties are normal. Work stays on session_id; hot sessions are left to adaptive skew joins, and ranks are cut before they
shuffle (row_number <= k).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.text import contains_like, fold, folded_like, ordered_text

RECALL = 3
# fixed values: the lines around recalled memories
HEADER = "以下是与当前问题相关的历史记忆："
FOOTER = "请结合这些记忆回答。"


def call_metadata(tool_calls: str = "tool_calls") -> Column:
    """What is saved of a message's tool calls: their JSON, ``null`` without any."""
    return F.coalesce(F.to_json(F.when(F.size(tool_calls) > 0, F.col(tool_calls))), F.lit("null"))


def save_turns(old: DataFrame, new: DataFrame, key: str = "id", order: str = "write_seq") -> DataFrame:
    """old with the rows of new: the last write of a key wins. Only new is ranked; old is anti-joined, not re-sorted. Where
    old has ``metadata`` and new has ``tool_calls`` instead, those are saved as it."""
    if "metadata" in old.columns and "metadata" not in new.columns:
        new = new.withColumn("metadata", call_metadata() if "tool_calls" in new.columns else F.lit("null"))
    newest = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    latest = new.withColumn("__rn", newest).filter("__rn = 1").select(*old.columns)
    return old.join(latest.select(key), key, "left_anti").select(*old.columns).unionByName(latest)


def with_folded(rows: DataFrame, *columns: str) -> DataFrame:
    """rows with ``__c`` for each column c: its fold, made once for all pairs that a row is in."""
    return rows.withColumns({f"__{c}": fold(F.col(c)) for c in columns})


def recall_topk(messages: DataFrame, queries: DataFrame, k: int = RECALL, keys: tuple[str, ...] = ("session_id", "q_seq"), before: Column | None = None) -> DataFrame:
    """For each query (session_id, q_seq, q): the k newest messages of its session whose content or reasoning holds q.
    rn counts from 1. ``before`` restricts the pairs further."""
    hit = folded_like(F.col("m.__content"), F.col("q.__q")) | folded_like(F.col("m.__reasoning_content"), F.col("q.__q"))
    same = (F.col("m.session_id") == F.col("q.session_id")) & hit
    pairs = with_folded(messages, "content", "reasoning_content").alias("m").join(with_folded(queries, "q").alias("q"), same if before is None else same & before)
    rows = pairs.select(*[F.col(f"q.{c}") for c in keys], "m.role", "m.content", "m.reasoning_content", "m.ts", "m.seq")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("ts"), F.desc("seq")))
    return rows.withColumn("rn", rank).filter(F.col("rn") <= k).select(*keys, "rn", "role", "content", "reasoning_content")


def get_sessions(messages: DataFrame, sessions: DataFrame | None = None, reasoning: bool = False) -> DataFrame:
    """session_id, pos (from 1, oldest first), role, content and, with ``reasoning``, reasoning_content."""
    if sessions is not None:
        messages = messages.join(sessions.select("session_id"), "session_id", "left_semi")
    pos = F.row_number().over(Window.partitionBy("session_id").orderBy("ts", "seq"))
    return messages.select("session_id", pos.alias("pos"), "role", "content", *(["reasoning_content"] if reasoning else []))


def clear_sessions(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """messages without the rows of the given sessions."""
    return messages.join(sessions.select("session_id"), "session_id", "left_anti").select(*messages.columns)


def memory_prompt(recalled: DataFrame, keys: tuple[str, ...] = ("session_id", "q_seq")) -> DataFrame:
    """keys, prompt: recalled rows as ``[role]: content`` lines, newest first, between the fixed lines."""
    line = F.concat(F.lit("["), "role", F.lit("]: "), "content")
    text = ordered_text(F.col("rn"), line, "\n")
    return recalled.groupBy(*keys).agg(F.concat(F.lit(HEADER + "\n"), text, F.lit("\n" + FOOTER)).alias("prompt"))


def build_context(history: DataFrame, prompts: DataFrame, keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """history (keys, seq, role, content) with each prompt (keys, prompt) as a system message behind the first system
    message; what stood before that one is dropped. Without one the prompt comes first; without a prompt nothing changes.
    Adds pos, from 1."""
    firsts = history.groupBy(*keys).agg(F.min(F.when(F.col("role") == "system", F.col("seq"))).alias("first"))
    told = prompts.join(firsts, [*keys], "left")  # one row per prompt
    kept = history.join(told.select(*keys, F.col("first")), [*keys], "left").filter(F.col("first").isNull() | (F.col("seq") >= F.col("first")))
    own = kept.select(*keys, F.col("seq").alias("a"), F.lit(0).alias("b"), "role", "content")
    memory = told.select(*keys, F.coalesce("first", F.lit(-1)).cast("long").alias("a"), F.lit(1).alias("b"), F.lit("system").alias("role"), F.col("prompt").alias("content"))
    pos = F.row_number().over(Window.partitionBy(*keys).orderBy("a", "b"))
    return own.unionByName(memory).select(*keys, pos.alias("pos"), "role", "content")


def _before_turns(messages: DataFrame, most: int) -> DataFrame:
    """Each user turn (turn_seq, q) with itself and the ``most`` messages before it, one row each: a window's frame, so the
    rows are turns x most at the most, whatever the length of a session."""
    frame = Window.partitionBy("session_id").orderBy("seq").rowsBetween(-most, 0)
    held = messages.withColumn("m", F.collect_list(F.struct("seq", "role", "content", "reasoning_content", "ts")).over(frame)).filter("role = 'user'")
    return held.select("session_id", F.col("seq").alias("turn_seq"), F.col("content").alias("q"), F.explode("m").alias("m")).select("session_id", "turn_seq", "q", "m.*")


def replay_prompts(messages: DataFrame, k: int = RECALL, max_history: int | None = None) -> DataFrame:
    """For every user turn, the messages that are sent: earlier history and the turn with its memories (recalled from
    what was saved before), then the turn once more. session_id, turn_seq, pos, role, content. Without ``max_history`` the
    rows grow with the square of a session; with it, history and memories come from that many messages before the turn."""
    turns = messages.filter("role = 'user'").select("session_id", F.col("seq").alias("turn_seq"), F.col("content").alias("q"))
    keys = ("session_id", "turn_seq")
    if max_history is None:
        recalled = recall_topk(messages, turns, k, keys, F.col("m.seq") < F.col("q.turn_seq"))
        pairs = messages.alias("h").join(turns.alias("u"), (F.col("h.session_id") == F.col("u.session_id")) & (F.col("h.seq") <= F.col("u.turn_seq")))
        history = pairs.select("h.session_id", "u.turn_seq", "h.seq", "h.role", "h.content")
    else:
        held = _before_turns(messages, max_history)
        hit = held.filter((F.col("seq") < F.col("turn_seq")) & (contains_like(F.col("content"), F.col("q")) | contains_like(F.col("reasoning_content"), F.col("q"))))
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("ts"), F.desc("seq")))
        recalled = hit.withColumn("rn", rank).filter(F.col("rn") <= k)
        history = held.select(*keys, "seq", "role", "content")
    prompts = memory_prompt(recalled, keys)
    sent = build_context(history, prompts, keys)
    again = turns.select(*keys, F.lit(1 << 30).alias("pos"), F.lit("user").alias("role"), F.col("q").alias("content"))
    pos = F.row_number().over(Window.partitionBy(*keys).orderBy("pos"))
    return sent.unionByName(again).select(*keys, pos.alias("pos"), "role", "content")


def keep_system(messages: DataFrame) -> DataFrame:
    """Only the system messages."""
    return messages.filter("role = 'system'")


def append_messages(messages: DataFrame, more: DataFrame) -> DataFrame:
    """more (same columns) behind each session's last message: seq goes on from the session's maximum."""
    last = messages.groupBy("session_id").agg(F.max("seq").alias("__last"))
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy("seq"))
    moved = more.withColumn("__rn", rank).join(last, "session_id", "left").withColumn("seq", F.coalesce("__last", F.lit(-1)) + F.col("__rn"))
    return messages.unionByName(moved.select(*messages.columns))


def replace_messages(messages: DataFrame, new: DataFrame) -> DataFrame:
    """The sessions of new get its rows instead of theirs."""
    return clear_sessions(messages, new.select("session_id").distinct()).unionByName(new.select(*messages.columns))
