"""Conversations: fan-out into prefixes, tokens with loss masks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .text import BOS, EOS, word_ids

#: Spans of a part.
_PART = 32
SCOPES = ("all_assistant", "last_span", "after_last_user", "all_tokens")


def conversations(turns: DataFrame, key: str = "conv_id", turn: str = "turn") -> DataFrame:
    """One row a conversation with ``messages`` in order of turn."""
    got = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), "role", F.col("text").alias("content"))))
    return turns.groupBy(key).agg(got.alias("m")).select(key, F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def expand_chat(df: DataFrame, field: str = "messages") -> DataFrame:
    """A row for each user query that an assistant answers: the messages up
    to the next user query. The ordinal counts user queries; conversations with
    one prefix keep their lineage."""
    at = F.transform(F.col(field), lambda m, i: F.when(m["role"] == "user", i))
    starts = F.filter(at, lambda i: i.isNotNull())
    n = F.size(field)

    def prefix(start: Column, k: Column) -> Column:
        stop = F.coalesce(F.try_element_at(F.col("_starts"), k + 2), n)
        answered = F.exists(F.slice(field, start + 1, stop - start), lambda m: m["role"] == "assistant")
        return F.struct(k.alias("ordinal"), F.when(answered, F.slice(field, 1, stop)).alias("messages"))

    lineage = F.col("lineage") if "lineage" in df.columns else F.array().cast("array<int>")
    found = df.withColumn("_starts", starts).withColumn("_p", F.filter(F.transform("_starts", prefix), lambda p: p["messages"].isNotNull()))
    out = found.select("*", F.size("_p").alias("_n"), F.explode("_p").alias("_one"))
    child = F.when(F.col("_n") > 1, F.concat(lineage, F.array(F.col("_one.ordinal").cast("int")))).otherwise(lineage)
    return out.withColumn("lineage", child).withColumn("ordinal", F.col("_one.ordinal").cast("int")).withColumn(field, F.col("_one.messages")).drop("_starts", "_p", "_n", "_one")


def expand_turns(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """The same fan-out on a table of turns: (key, ordinal, stop). No
    conversation is gathered into one row."""
    order = W.partitionBy(key).orderBy("turn")
    numbered = turns.withColumn("ordinal", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(order) - 1)
    per = numbered.where("ordinal >= 0").groupBy(key, "ordinal").agg(F.max("turn").alias("last"), F.max(F.when(F.col("role") == "assistant", 1).otherwise(0)).alias("answered"))
    return per.where("answered = 1").select(key, "ordinal", (F.col("last") + 1).alias("stop"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once a row, also where ``body``
    uses it for every element of an array."""
    return F.element_at(F.transform(F.array(value), body), 1)


def supervised(messages: Column, scope: str) -> Column:
    """For each message whether the scope selects it."""
    if scope not in SCOPES:
        raise ValueError(f"loss scope is one of {SCOPES}, not {scope!r}")
    if scope in ("all_assistant", "all_tokens"):
        return F.transform(messages, lambda m: m["role"] == "assistant")
    # Places of roles, found once for all messages.
    last_of = lambda roles, test: F.coalesce(F.array_max(F.transform(roles, lambda r, i: F.when(test(r, i), i))), F.lit(-1))
    within = lambda roles, after: F.transform(roles, lambda r, i: (r == "assistant") & (i > after))
    every = F.transform(messages, lambda m: F.coalesce(m["role"], F.lit("")))
    if scope == "after_last_user":
        return let(every, lambda roles: let(last_of(roles, lambda r, _: r == "user"), lambda user: within(roles, user)))
    last = lambda roles: last_of(roles, lambda r, _: r == "assistant")
    # The last message before it that is not of the assistant begins no part of the final run.
    begin = lambda roles, end: last_of(roles, lambda r, i: (r != "assistant") & (i < end))
    return let(every, lambda roles: let(last(roles), lambda end: let(begin(roles, end), lambda after: within(roles, after))))


def tokenize_chat(df: DataFrame, field: str = "messages", *, scope: str = "all_assistant", special_tokens: str = "none", assistant_eos: bool = True, bos: int = BOS, eos: int = EOS, drop: bool = True) -> DataFrame:
    """input_ids and loss_mask of the contents joined without a template. An
    assistant's message ends in EOS, which is supervised with it. Rows of less
    than two ids or without supervision go; a supervised first id is an error."""
    selected = F.transform(F.arrays_zip(F.col(field).alias("m"), supervised(F.col(field), scope).alias("s")), lambda x: F.struct(_message_ids(x["m"], assistant_eos, eos).alias("ids"), x["s"].alias("s")))
    out = df.withColumn("_parts", selected)
    ids = F.flatten(F.transform("_parts", lambda p: p["ids"]))
    loss = F.flatten(F.transform("_parts", lambda p: F.transform(p["ids"], lambda _: F.when(p["s"], 1).otherwise(0).cast("tinyint"))))
    one = lambda v: F.array(F.lit(v).cast("tinyint"))
    if "eos" in special_tokens:
        reached = F.element_at(F.concat(one(0), loss), -1)
        ids, loss = F.concat(ids, F.array(F.lit(eos).cast("bigint"))), F.concat(loss, F.array(reached))
    if "bos" in special_tokens:
        ids, loss = F.concat(F.array(F.lit(bos).cast("bigint")), ids), F.concat(one(0), loss)
    if scope == "all_tokens":
        loss = F.transform(ids, lambda _, i: F.when(i == 0, 0).otherwise(1).cast("tinyint"))
    out = out.withColumn("input_ids", ids).withColumn("loss_mask", loss).drop("_parts")
    if drop:
        out = out.where((F.size("input_ids") >= 2) & F.exists("loss_mask", lambda m: m == 1))
        out = out.withColumn("loss_mask", F.when(F.element_at("loss_mask", 1) == 1, F.raise_error(F.lit("the first token is supervised")).cast("array<tinyint>")).otherwise(F.col("loss_mask")))
    return out


def _message_ids(message: Column, assistant_eos: bool, eos: int) -> Column:
    ids = word_ids(F.coalesce(message["content"], F.lit("")))
    if not assistant_eos:
        return ids
    return F.when(message["role"] == "assistant", F.concat(ids, F.array(F.lit(eos).cast("bigint")))).otherwise(ids)


def render_chat(df: DataFrame, field: str = "messages", begin: str = "<|{role}|>\n", end: str = "\n") -> DataFrame:
    """A plain template: each message between a role mark and an end mark,
    with the character spans of its content (for span masks)."""
    before, _, after = begin.partition("{role}")

    def step(acc: Column, m: Column) -> Column:
        head = F.concat(acc["text"], F.lit(before), m["role"], F.lit(after))
        start, content = F.length(head), F.coalesce(m["content"], F.lit(""))
        span = F.struct(start.alias("start"), (start + F.length(content)).alias("stop"), m["role"].alias("role"))
        return F.struct(F.concat(head, content, F.lit(end)).alias("text"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    none = F.array().cast("array<struct<start:int,stop:int,role:string>>")
    made = F.aggregate(field, F.struct(F.lit("").alias("text"), none.alias("spans")), step)
    return df.withColumn("_r", made).withColumn("text", F.col("_r.text")).withColumn("spans", F.col("_r.spans")).drop("_r")


def mask_of_spans(offsets: Column, spans: Column) -> Column:
    """A token counts if its characters overlap a span. Spans are looked
    through in parts, most of which a token passes over at once."""
    meets = lambda o, s: (o["start"] < s["stop"]) & (o["stop"] > s["start"])
    part = lambda these: F.struct(these.alias("these"), F.array_min(these["start"]).alias("start"), F.array_max(these["stop"]).alias("stop"))
    firsts = F.when(F.size(spans) > 0, F.sequence(F.lit(1), F.size(spans), F.lit(_PART))).otherwise(F.array().cast("array<int>"))
    parts = F.transform(firsts, lambda i: let(F.slice(spans, i, F.lit(_PART)), part))
    found = lambda all_: F.transform(offsets, lambda o: F.when(F.exists(all_, lambda p: meets(o, p) & F.exists(p["these"], lambda s: meets(o, s))), 1).otherwise(0).cast("tinyint"))
    return let(parts, found)
