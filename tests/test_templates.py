import hashlib
import re

import pytest
from pyspark.sql import functions as F

from millrace.functions import encoders, templates

TALKS = {
    "plain": [("system", "be brief"), ("user", "one two"), ("assistant", "three"), ("user", "four"), ("assistant", " five six ")],
    "two replies": [("user", "a"), ("assistant", "b"), ("assistant", "c é😀"), ("user", "d")],
    "no reply": [("user", "a")],
    "null content": [("user", None), ("assistant", "x")],
    "empty": [],
    "null": None,
}
MARKS = {"chatml": ("", "<|im_start|>{}\n", "<|im_end|>\n"), "headers": ("<|begin_of_text|>", "<|start_header_id|>{}<|end_header_id|>\n\n", "<|eot_id|>"), "turns": ("<bos>", "<start_of_turn>{}\n", "<end_of_turn>\n"), "role_lines": ("", "<|{}|>\n", "</s>\n")}


def talks(spark):
    rows = [(k, None if v is None else [{"role": r, "content": c} for r, c in v]) for k, v in TALKS.items()]
    return spark.createDataFrame(rows, "name string, messages array<struct<role:string,content:string>>")


def by_hand(talk, name, scope, header):
    """Ids and mask by plain loops; the last run is cut out of the mask."""
    begin, head, end = MARKS[name]
    text, spans = begin, []
    users = [i for i, (r, _) in enumerate(talk) if r == "user"]
    for i, (role, content) in enumerate(talk):
        content = content or ""
        start = len(text)
        text += head.format("model" if (name, role) == ("turns", "assistant") else role)
        start = start if header else len(text)
        text += (content.strip() if name in ("headers", "turns") else content) + end
        if role == "assistant" and (scope != "after_last_user" or i > max(users, default=-1)):
            spans.append((start, len(text)))
    tokens = [(int(hashlib.md5(m.group().encode()).hexdigest()[:8], 16) % 10000 + 10, m.start(), m.end()) for m in re.finditer("[^ \t\n\r\x0b\x0c]+", text)]
    mask = [int(any(a < stop and b > start for start, stop in spans)) for _, a, b in tokens]
    if scope == "last_span" and 1 in mask:
        last = len(mask) - 1 - mask[::-1].index(1)
        first = last
        while first and mask[first - 1]:
            first -= 1
        mask = [int(first <= i <= last) for i in range(len(mask))]
    return [t[0] for t in tokens], mask


@pytest.mark.parametrize("name", MARKS)
def test_templates_by_hand(spark, name):
    for scope, source, header in (("all_assistant", "auto", False), ("last_span", "auto", False), ("after_last_user", "generation", False), ("all_assistant", "prefix_diff", True)):
        out = templates.tokenize_chat_template(talks(spark), encoders.word_offsets(), template=name, scope=scope, span_source=source, supervise_header=header, special_tokens="none")
        got = {r["name"]: (r.input_ids, r.loss_mask) for r in out.collect()}
        want = {k: by_hand(v, name, scope, header) for k, v in TALKS.items() if v}
        assert got == {k: v for k, v in want.items() if 1 in v[1]}


def test_tags_and_comparison_agree(spark):
    both = [templates.tokenize_chat_template(talks(spark), encoders.word_offsets(), span_source=s).orderBy("name").collect() for s in ("generation", "prefix_diff")]
    assert both[0] == both[1] and len(both[0]) == 3


def test_ends(spark):
    def one(**options):
        r = templates.tokenize_chat_template(talks(spark).where("name = 'null content'"), encoders.word_offsets(), **options).first()
        return r and (len(r.input_ids), r.input_ids[-1], r.loss_mask)

    # <|im_start|>user | <|im_end|> | <|im_start|>assistant | x<|im_end|>
    assert one(special_tokens="none")[2] == [0, 0, 0, 1]
    assert one()[1:] == (2, [0, 0, 0, 1, 1])
    assert one(max_length=4)[2] == [0, 0, 0, 1]
    assert one(special_tokens="bos_eos")[1:] == (2, [0, 0, 0, 0, 1, 1])
    assert one(special_tokens="eos", max_length=4) is None
    assert one(scope="all_tokens")[2] == [0, 1, 1, 1, 1]
    text = talks(spark).where("name = 'plain'")
    cut = templates.tokenize_chat_template(text, encoders.word_offsets(), special_tokens="eos", max_length=9).first()
    assert cut.input_ids[-1] == 2 and cut.loss_mask[-1] == 0 and cut.loss_mask[-2] == 1 and len(cut.input_ids) == 9


def test_templates_of_ones_own(spark):
    encode = encoders.word_offsets()
    spoken = lambda messages, prompt: F.concat(F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), m["content"], F.lit(" ; "))), ""), F.lit("assistant: " if prompt else ""))
    plain = talks(spark).where("name = 'plain'")
    got = templates.tokenize_chat_template(plain, encode, template=spoken, special_tokens="none").first()
    assert got.loss_mask == [0] * 4 + [0] * 4 + [0] + [1, 1] + [0] * 3 + [0] + [1] * 3
    by_place = lambda messages, prompt: F.concat(F.size(messages).cast("string"), spoken(messages, prompt))
    with pytest.raises(Exception, match="renders by position"):
        templates.tokenize_chat_template(plain, encode, template=by_place).collect()
    for options in ({"template": "none such"}, {"template": spoken, "span_source": "generation"}, {"template": spoken, "scope": "after_last_user"}, {"scope": "all_tokens", "span_source": "prefix_diff"}, {"supervise_header": True, "scope": "all_tokens"}, {"special_tokens": "both"}):
        with pytest.raises(ValueError):
            templates.tokenize_chat_template(plain, encode, **options)
