"""Chat templates: conversations as one text, its supervised characters, and
token ids with loss masks.

A template is a function of columns, (messages, prompt) -> text, where
``prompt`` asks for the mark that opens a reply. ``Template`` states one by its
marks; any other function may be given as well."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chat import SCOPES, let, mask_of_spans, supervised
from .text import BOS, EOS, brackets

Renderer = Callable[[Column, bool], Column]
SPAN_SOURCES = ("auto", "generation", "prefix_diff")
SPECIAL = (None, "none", "bos", "eos", "bos_eos")


@dataclass(frozen=True)
class Template:
    """``begin`` once, then for each message ``head`` (with ``{role}``), the
    content and ``end``. ``shown`` renames roles. With ``tagged`` a reply is
    its content and end mark, so no partial texts need be compared."""

    head: str
    end: str
    begin: str = ""
    shown: tuple[tuple[str, str], ...] = ()
    trim: bool = False
    tagged: bool = True

    def __call__(self, messages: Column, prompt: bool = False) -> Column:
        said = F.transform(messages, lambda m: F.concat(self.opening(m["role"]), self.content(m), F.lit(self.end)))
        return F.concat(F.lit(self.begin), F.array_join(said, ""), self.opening(F.lit("assistant")) if prompt else F.lit(""))

    def opening(self, role: Column) -> Column:
        role = F.coalesce(role, F.lit(""))
        name = role
        for old, new in self.shown:
            name = F.when(role == old, new).otherwise(name)
        before, _, after = self.head.partition("{role}")
        return F.concat(F.lit(before), name, F.lit(after))

    def content(self, message: Column) -> Column:
        text = F.coalesce(message["content"], F.lit(""))
        return F.regexp_replace(text, r"^\s+|\s+$", "") if self.trim else text


# The marks of widely used chat formats.
TEMPLATES = {
    "chatml": Template("<|im_start|>{role}\n", "<|im_end|>\n"),
    "headers": Template("<|start_header_id|>{role}<|end_header_id|>\n\n", "<|eot_id|>", begin="<|begin_of_text|>", trim=True),
    "turns": Template("<start_of_turn>{role}\n", "<end_of_turn>\n", begin="<bos>", shown=(("assistant", "model"),), trim=True),
    "role_lines": Template("<|{role}|>\n", "</s>\n"),
}


def named(template: str | Renderer) -> Renderer:
    if not isinstance(template, str):
        return template
    if template not in TEMPLATES:
        raise ValueError(f"no template {template!r}; there are {sorted(TEMPLATES)}")
    return TEMPLATES[template]


def _span(start: Column, stop: Column, at: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), stop.cast("int").alias("stop"), at.cast("int").alias("at"))


def _tagged_spans(messages: Column, template: Template) -> Column:
    """Start, stop and place of each message's content and end mark. Lengths
    are summed over the messages before, so no partial text is made."""
    sizes = F.transform(messages, lambda m: F.struct(F.length(template.opening(m["role"])).alias("head"), (F.length(template.content(m)) + len(template.end)).alias("body")))
    before = lambda all_, i: F.aggregate(F.slice(all_, 1, i), F.lit(len(template.begin)), lambda a, s: a + s["head"] + s["body"])
    return let(sizes, lambda all_: F.transform(all_, lambda s, i: let(before(all_, i) + s["head"], lambda start: _span(start, start + s["body"], i))))


def _compared_spans(messages: Column, template: Renderer, header: bool) -> Column:
    """The same from partial texts: a reply is what the text gains by it over
    the text before with (or, with ``header``, without) the opening of a reply.
    Where these do not begin one another the template renders by position and
    no span is right: an error."""

    def one(whole: Column, m: Column, i: Column) -> Column:
        upto, prefix = template(F.slice(messages, 1, i + 1), False), template(F.slice(messages, 1, i), not header)
        fits = F.startswith(whole, upto) & F.startswith(upto, prefix)
        bad = F.raise_error(F.lit("the template renders by position: partial texts are no prefixes of the whole")).cast("int")
        reply = m["role"] == "assistant"
        return F.when(reply & ~fits, _span(bad, bad, i)).when(reply, _span(F.length(prefix), F.length(upto), i)).otherwise(_span(F.lit(0), F.lit(0), i))

    return let(template(messages, False), lambda whole: F.transform(messages, lambda m, i: one(whole, m, i)))


def _last_run(mask: Column) -> Column:
    """Only the last unbroken run of ones."""
    places = F.transform(mask, lambda v, i: F.struct(i.alias("i"), v.alias("v")))
    top = lambda test: F.coalesce(F.array_max(F.transform(F.filter(places, test), lambda p: p["i"])), F.lit(-1))
    within = lambda last: let(top(lambda p: (p["v"] == 0) & (p["i"] < last)), lambda gap: F.transform(mask, lambda v, i: F.when((i > gap) & (i <= last), v).otherwise(0).cast("tinyint")))
    return let(top(lambda p: p["v"] == 1), within)


def tokenize_chat_template(
    df: DataFrame,
    encode: Callable[[Column], Column],
    field: str = "messages",
    template: str | Renderer = "chatml",
    *,
    scope: str = "all_assistant",
    span_source: str = "auto",
    supervise_header: bool = False,
    special_tokens: str | None = None,
    max_length: int | None = None,
    bos: int = BOS,
    eos: int = EOS,
    drop: bool = True,
) -> DataFrame:
    """input_ids and loss_mask of conversations written out by a template.

    ``encode`` gives (id, start, stop) of a text's tokens (see ``encoders``). A
    token is supervised if its characters meet those of a selected reply. Spans
    are stated by the template ("generation") or found by comparing partial
    texts ("prefix_diff"); "auto" takes the first where it can. Without
    ``special_tokens`` a missing last EOS is added if there is room, supervised
    as the token before it. With "eos" or "bos_eos" the EOS is supervised if the
    text ends in a selected reply that was not cut. ``max_length`` counts added
    ids. Null or empty conversations, rows of less than two ids or without
    supervision go (``drop``); a supervised first id is an error."""
    render = named(template)
    tagged = isinstance(render, Template) and render.tagged
    if scope not in SCOPES or span_source not in SPAN_SOURCES or special_tokens not in SPECIAL:
        raise ValueError(f"scope is one of {SCOPES}, span_source of {SPAN_SOURCES}, special_tokens of {SPECIAL}")
    if span_source == "generation" and not tagged:
        raise ValueError("the template does not tag replies; take span_source='prefix_diff'")
    if scope == "all_tokens" and span_source != "auto":
        raise ValueError("all_tokens takes no spans; leave span_source='auto'")
    if supervise_header and (span_source == "generation" or scope == "all_tokens"):
        raise ValueError("supervise_header is for spans found by prefix_diff")
    if scope == "after_last_user" and not tagged and span_source == "auto":
        raise ValueError("after_last_user takes a tagged template or span_source='prefix_diff'")
    by_tags = tagged and span_source != "prefix_diff" and not supervise_header
    messages = F.col(field)
    # The last run is taken among tokens, where marks part replies.
    picked = "all_assistant" if scope == "last_span" else scope

    def replies(m: Column) -> Column:
        spans = _tagged_spans(m, render) if by_tags else _compared_spans(m, render, supervise_header)
        return let(supervised(m, picked), lambda c: F.filter(spans, lambda s: F.element_at(c, s["at"] + 1)))

    kept = F.array().cast("array<struct<start:int,stop:int,at:int>>") if scope == "all_tokens" else let(messages, replies)
    some = F.size(F.coalesce(messages, F.array().cast(dict(df.dtypes)[field]))) > 0
    out = df.withColumn("_text", F.when(some, render(messages, False))).withColumn("_spans", F.when(some, kept)).withColumn("_tokens", F.coalesce(encode(F.col("_text")), F.array().cast("array<struct<id:bigint,start:int,stop:int>>")))
    before, after = brackets(special_tokens or "none", bos, eos)
    room = None if max_length is None else max(0, max_length - len(before) - len(after))
    tokens = F.col("_tokens") if room is None else F.slice("_tokens", 1, room)
    cut = F.lit(False) if room is None else F.size("_tokens") > room
    fixed = lambda values: F.array(*[F.lit(v).cast("bigint") for v in values]).cast("array<bigint>")
    one = lambda v: F.array(v.cast("tinyint"))
    both = lambda ids, loss: F.struct(ids.alias("ids"), loss.alias("loss"))

    def marked(known: Column) -> Column:
        loss = F.coalesce(mask_of_spans(known["tokens"], known["spans"]), F.array().cast("array<tinyint>"))
        return both(F.transform(known["tokens"], lambda t: t["id"]), loss)

    def ended(r: Column) -> Column:
        """The last EOS where it is missing and has room."""
        wanting = (F.size(r["ids"]) > 0) & (F.try_element_at(r["ids"], F.lit(-1)) != eos) & (F.lit(True) if max_length is None else F.size(r["ids"]) < max_length)
        return F.when(wanting, both(F.concat(r["ids"], fixed([eos])), F.concat(r["loss"], one(F.try_element_at(r["loss"], F.lit(-1)))))).otherwise(r)

    def bracketed(r: Column) -> Column:
        ids, loss = r["ids"], r["loss"]
        if after:
            reached = ~cut & F.coalesce(F.exists("_spans", lambda s: (s["start"] <= F.length("_text")) & (F.length("_text") <= s["stop"])), F.lit(False))
            ids, loss = F.concat(ids, fixed(after)), F.concat(loss, one(reached.cast("int")))
        if before:
            ids, loss = F.concat(fixed(before), ids), F.concat(one(F.lit(0)), loss)
        return both(ids, loss)

    def scoped(r: Column) -> Column:
        if scope == "last_span":
            return both(r["ids"], _last_run(r["loss"]))
        if scope == "all_tokens":
            return both(r["ids"], F.transform(r["ids"], lambda _, i: F.when(i == 0, 0).otherwise(1).cast("tinyint")))
        return r

    made = let(F.struct(tokens.alias("tokens"), F.col("_spans").alias("spans")), marked)
    made = let(let(made, ended if special_tokens is None else bracketed), scoped)
    out = out.withColumn("_made", made).withColumns({"input_ids": F.col("_made.ids"), "loss_mask": F.col("_made.loss")}).drop("_text", "_spans", "_tokens", "_made")
    if drop:
        out = out.where(some & (F.size("input_ids") >= 2) & F.exists("loss_mask", lambda m: m == 1))
        out = out.withColumn("loss_mask", F.when(F.element_at("loss_mask", 1) == 1, F.raise_error(F.lit("the first token is supervised")).cast("array<tinyint>")).otherwise(F.col("loss_mask")))
    return out
