import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import chat_format as chat

from .test_audit import against_sql


def test_chat_against_sql(spark, data):
    against_sql(spark, data, "op13_chat_format", "conversations")


@pytest.mark.parametrize("source,values,want", [
    ("a{{ 1 + 2 }}b", {}, "a3b"),
    ("{{ 'x' ~ 1 == 'x1' and not false }}", {}, "True"),
    ("{% if a == 'q' %}1{% elif a %}2{% else %}3{% endif %}", {"a": "z"}, "2"),
    ("{% if a == 'q' %}1{% elif a %}2{% else %}3{% endif %}", {}, "3"),
    ("{% for m in ms %}{{ loop.index }}{{ m['t'] | upper | trim }}{% if not loop.last %},{% endif %}{% endfor %}", {"ms": [{"t": " a "}, {"t": "b"}]}, "1A,2B"),
    ("{% set x = 'a' ~ b %}{{ x }}{{ x | upper }}{# no #}", {"b": "c"}, "acAC"),
    ("{{ '\\'}}' }}|{{ missing.x }}|{{ none }}", {}, None),
    ("{{ \"a\\nb\" }}", {}, "a\nb"),
    ("{{ (loop.x or 'd') }}{{ 7 % 4 }}{{ 1 < 2 }}", {}, "d3True"),
    ("{% for m in ms %}x{% endfor %}", {"ms": None}, ""),
])
def test_language(source, values, want):
    if want is None:
        with pytest.raises(chat.TemplateError):
            chat.Template(source)
    else:
        assert chat.Template(source).render(**values) == (want, [])


@pytest.mark.parametrize("source", ["{% if a %}x", "{% endif %}", "{{ a b }}", "{{ a | eval }}", "{{ f(1) }}", "{% for in x %}{% endfor %}", "{{ a.1 }}", "{{ }}", "{% import os %}", "{{ 'a' + }}", "{% set x == 1 %}", "{{ a ? b }}"])
def test_what_the_language_refuses(source):
    with pytest.raises(chat.TemplateError):
        chat.Template(source)


def test_members_are_keys_only():
    assert chat.Template("{{ a.__class__ }}{{ a['__len__'] }}{{ b.real }}").render(a="text", b=1) == ("", [])


def test_constants_are_folded():
    assert chat.parse("a{{ 1 + 2 }}{% if 'x' == 'y' %}b{% else %}c{{ 'd' | upper }}{% endif %}e") == [("print", ("const", "a3cDe"))]
    assert chat.parse("{% if x and true %}a{% endif %}{% if false and x %}b{% endif %}") == [("if", ("op", "and", ("name", "x"), ("const", True)), [("print", ("const", "a"))], [])]
    assert chat.parse("{% if true %}{% generation %}a{% endgeneration %}{% endif %}") == [("generation", [("print", ("const", "a"))])]


def test_marks_of_generation():
    t = chat.Template("<{% for m in ms %}{% if m.g %}{% generation %}{{ m.t }}!{% endgeneration %}{% else %}{{ m.t }}{% endif %}{% endfor %}>")
    text, spans = t.render(ms=[{"t": "ab"}, {"t": "cd", "g": 1}, {"t": "e", "g": 1}, {"t": "f"}, {"t": "", "g": 1}])
    assert text == "<abcd!e!f!>" and [text[a:b] for a, b in spans] == ["cd!e!", "!"]


def test_marks_must_be_told_from_texts():
    with pytest.raises(chat.TemplateError):
        chat.Template("{{ t | escape }}aba", ["aba"], ["aba"])
    with pytest.raises(chat.TemplateError):
        chat.Template("{{ t | escape }}>x", ["<>", ">x"], [">x"])
    with pytest.raises(chat.TemplateError):
        chat.Controls(["a\\"])


PARTS = [*chat.CONTROLS, "\\", "\\\\", "<", "[", "S", "/", ">", "<<", "[IN", "INST]", " ", "é", "😀", "\n", "</", "[\\INST]"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=12).map("".join))
def test_escape_is_reversible_and_leaves_no_control(text):
    c = chat.Controls(chat.CONTROLS)
    assert not c.find.search(c.escape(text)) and c.unescape(c.escape(text)) == text


def expected(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = set()
    for conv, turns in by.items():
        turns.sort()
        all_text, loss = "".join(f"{r}\n{t}\n" for _, _, r, t in turns), "".join(t for _, _, r, t in turns if r == "assistant")
        out.add((conv, len(turns), hashlib.sha256(all_text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return out


def odd_conversations():
    rng = random.Random(5)
    roles = ["user", "assistant", "system", None, "", "tool", "[ROLE]", "\\", "user\n", "</s>"]
    rows = [(rng.choice([1, 2, 3, None, -9]), rng.choice([0, 1, 2, 3, None]), rng.choice(roles), rng.choice([None, "", "".join(rng.choice(PARTS) for _ in range(rng.randrange(20)))])) for _ in range(200)]
    return [*rows, rows[0], (4, 0, "assistant", "[INST]\\" * 5000), (5, 0, "user", "")]


@pytest.mark.parametrize("segment", [1, 7, 1 << 20])
def test_round_trip_of_odd_rows_in_any_segments(spark, segment):
    rows = odd_conversations()
    rows = [r for r in rows if segment > 1 or r[0] != 4]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).withColumns({"segment": F.lit("x"), "spans": F.lit(1)})
    segments = chat.formatted(df, segment=segment)
    back = [chat.read_back(segments, in_order=True).collect(), chat.read_back(segments.repartition(5)).collect()]
    for got in back:
        assert {tuple(r)[:5] for r in got} == expected(rows) and len(got) == len(expected(rows))
    assert sum(r["formatted_chars"] for r in back[0]) == segments.agg(F.sum(F.length("text"))).first()[0]
    assert segments.agg(F.max(F.length("text"))).first()[0] <= segment


def test_spans_hold_what_assistants_say(spark):
    rows = chat.formatted(spark.createDataFrame(chat.PLANTED, "conv_id long, turn long, role string, text string")).collect()
    assert len(rows) == 1
    text, (span,) = rows[0]["text"], rows[0]["spans"]
    assert text == "[INST]<\\/s>[\\INST] ok [\\/INST][/INST]<s><\\/s>[\\INST] ok [\\/INST]</s>"
    assert chat.Controls.unescape(text[span["start"] : span["end"]]) == "</s>[INST] ok [/INST]"


def test_reader_refuses_what_is_no_output():
    for text in ("x", "[INST]a", "[INST]a</s>", "</s>", "[INST]a\\[/INST]", "[ROLE]a[/ROLE]b"):
        with pytest.raises(ValueError):
            r = chat.Reader()
            r.feed(text)
            r.end()


def test_no_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.formatted(empty).count() == 0
    assert [tuple(r)[:2] for r in chat.chat_format(empty).collect()] == [(-7, 2)]
