"""Sentences, defects, packing, mixing and splitting: hand-made cases, round trips and edge cases."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrion.llm import defects, mixing, packing, sentences, splitting
from quarrion.llm.sentences import sentence_spans
from quarrion.llm.tokens import tokenizer


def units(text):
    return [text[a:b] for a, b in sentence_spans(text)]


CASES = [
    "The mill closed in 1917. | iron was sold there. | Was it so dear in 1920? | the parish paid. | Oh! said Ann of Acme Corp. and left.",
    "Dr. Low met Prof. Fox at 6 a.m. | The vessel closed at 3 p.m. Monday.",
    "It moved to the U.S. | A copper, etc. were lit by approx. 15 crews. | The U.S. fort won.",
    "He asked, \"Who? Me?\" and left. | 'The ledger was divided.' | By 1960 it ended.",
    "“Stop! We must go,” said Ann. | (All was lost in 1975.) | Next (was it?) came.",
    "Near Manamere.[28] | eCargo won. | Lot 7.D holds. | It cost .89 of 2.6.7 here.",
    "Lipind Inc. won. | It was painted by Valick Co. | The end... | Why?! | 556 plans.",
    "It was by Tesolert Jr. and by Sr. Fox near Sec. 12.2 and Fig. 3. | On Aug. 26, 1984, it fell.",
    "Am 24. Mai räumte Dr. Low z. B. das Haus bzw. 39.500 Taler. | „Zu. Wir gehen“, sagte Eva. | Im Jahr 1817. | Das Tor (vgl. Nr. 63, S. 3 ff.) fiel.",
    "Le quai (cf. art. 28.5) tomba… | « Fermé. Partons ! » dit Zoé. | M. Roux et Mme Lys vinrent au no. 48. | Fin !",
    "El Sr. Gil y la Dra. Paz p. ej. en EE. UU. viven (véase pág. 38). | —Cerrado. Vámonos —dijo Eva. | ¿Quién? | ¡Sí!",
    "图书馆问：“谁翻译了灯塔？”|“我们走。好吗？”商会说。|旧桥（见附件8.1）塌了……|价格涨了64.4%！",
    "「灯台を見た。帰ろう。」と職員は述べた。|運河はなぜ？|長さは53.4メートル。",
    "डॉ. परिषद ने देखा। | “बंद है। हम चलते हैं,” समिति ने कहा। | क्यों मापा? | 1877 में!",
    "قال د. اللجنة: «أعاد المدقق البرج». | لماذا ترك؟ | ترك 40.2 متر؛ ثم عاد!",
    "แผนที่ยาว82.2เมตร| |ช่างสำรวจซ่อมแซม| |ในปี1867",
]


@pytest.mark.parametrize("case", CASES)
def test_sentences(case):
    parts = [p.strip() for p in case.split("|") if p.strip()]
    assert units(case.replace("| |", " ").replace(" | ", " ").replace("|", "")) == parts


def test_sentence_layout():
    assert units("Title\n\nOne line\nwraps here. Two.\r\n\r\nThree") == ["Title", "One line\nwraps here.", "Two.", "Three"]
    assert units(" \xa0 ") == [] and units("") == [] and sentence_spans(None) == []
    assert units("He said “never closed. Then it went on. Fine.") == ["He said “never closed.", "Then it went on.", "Fine."]
    assert units("au no.\n79. En 1902 il vint.") == ["au no.\n79.", "En 1902 il vint."]
    long = "Word word word. " * 5000
    assert len(units(long)) == 5000


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB1 .!?\"“”()\n。「」—'", max_size=120))
def test_sentences_cover_the_text(text):
    spans = sentence_spans(text)
    assert all(a < b and not text[a].isspace() and not text[b - 1].isspace() for a, b in spans)
    assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))
    covered = {i for a, b in spans for i in range(a, b)}
    assert all(i in covered or text[i].isspace() for i in range(len(text)))


def test_sentence_table(spark):
    rows = spark.createDataFrame([("a", "One. Two.", 1), ("b", None, 2), ("c", " ", 3), (None, "X.", 4)], "passage_id string, text string, char_start int")
    got = sentences.split_sentences(rows, "passage_id", "text").orderBy("passage_id", "sent_index").collect()
    assert [(r["passage_id"], r["sentence"]) for r in got] == [(None, "X."), ("a", "One."), ("a", "Two.")]
    assert sentences.split_sentences(rows.limit(0), "passage_id", "text").count() == 0


# --- defects ---------------------------------------------------------------------------------------------------

Q = "Who designed the copper aqueduct of Meger Charter?"
FULL = [f"The {n} of Meger Charter was designed by Vemal Savahand, after the {m} had been lit by the guild of the district." for n in ("mill", "quay", "gate", "wall") for m in ("canal", "tower", "bridge", "ledger", "garden")]


@pytest.fixture(scope="module")
def model():
    ends = [(x.rstrip("."), "en", defects.normal(Q), ["vemal", "savahand"]) for x in FULL]
    ends += [(x.split(",")[0], *rest) for x, *rest in ends] + [("Vemal Savahand", *ends[0][1:])] * 9
    pairs = [(f"Who designed the {a} {b} of Meger Charter?", "Vemal Savahand") for a in ("old", "copper", "wide", "northern") for b in ("aqueduct", "mill", "tower")]
    pairs += [(f"In which year was the {b} at Lower Hakan first lit?", "1874") for b in ("harbour", "granary", "observatory", "quay")]
    return defects.Models(defects.fit_copies(pairs), defects.fit_ends(ends * 10))


def test_copies_hang_on_compression(model):
    said = [Q, f"{Q} {Q}", "Who designed copper aqueduct Meger Charter?", f"{Q} Vemal Savahand", "It was designed by Vemal Savahand of Meger Charter."]
    assert [defects.is_copy(x, Q, [], model.copies) for x in said] == [True, True, True, False, False]
    assert not any(defects.is_copy(x, Q, [], None) for x in said)
    small, large = defects.added_bytes(Q.encode(), Q.encode()), defects.added_bytes(Q.encode(), b"nothing of it")
    assert small < 10 < 30 < large


def test_ends_of_held_out_answers():
    rng = random.Random(2)
    parts = ["mill", "quay", "gate", "wall", "canal", "tower", "bridge", "ledger"], ["opened", "closed", "divided", "repaired"], ["guild", "council", "clerk", "parish"]
    texts = [f"The {rng.choice(parts[0])} of Lower {rng.choice(['Hakan', 'Medburg', 'Sotal'])} was {rng.choice(parts[1])} by the {rng.choice(parts[2])} in {rng.randint(1700, 1990)}" for _ in range(400)]
    model = defects.Models(ends=defects.fit_ends([(x, "en", [], []) for x in texts[:200]]))
    whole = [model.ended(x, "en", [], []) > 0 for x in texts[200:]]
    cut = [model.ended(x[: rng.randrange(12, len(x) - 7)].rstrip(), "en", [], []) < 0 for x in texts[200:]]
    assert sum(whole) >= 195 and sum(cut) >= 190


@pytest.mark.parametrize(
    ("answer", "kind"),
    [
        (None, "empty_answer"), ("", "empty_answer"), (" ​﻿", "empty_answer"), ("**Answer:** ", "empty_answer"), ("<p></p>", "empty_answer"), ("[]", "empty_answer"),
        (Q, "question_copy"), (Q.upper(), "question_copy"), (f"Question: {Q}", "question_copy"), (f"{Q}\n{Q[:-3]}", "question_copy"),
        ("Who designed copper aqueduct Meger Charter?", "question_copy"), (f"{Q} Vemal Savahand.", None), (f"{Q} Answer: Vemal Savahand.", None),
        ("I don’t know", "refusal"), ("unknown", "refusal"), ("Sorry, none of the 14 passages mentions it.", "refusal"), ("Je ne sais pas.", "refusal"),
        ("Hmm, I do not have enough information about the mill to answer.", "refusal"), ("Das weiß ich leider nicht.", "refusal"), ("No lo sé.", "refusal"),
        ("Sorry for the long list of passages: it was Vemal Savahand.", None), ("The old sign read \"we cannot answer here\"; it was designed by Vemal Savahand.", None),
        ("It is stated that the mill could not be found at first, yet Vemal Savahand is named as the answer.", None),
        ("Es handelt sich dabei um Vemal Savahand.", "wrong_language"), ("根据段落，答案是87。", "wrong_language"), ("On lit dans la lettre que c'est Vemal Savahand", "wrong_language"),
        ("The deed says “Der Rat räumte das Haus.” and so it was designed by Vemal Savahand.", None),
        ("Vemal Savahand", None), ("It was designed by Vemal Savahand", None), ("It was designed by Vemal Sava", "truncated_answer"),
        ("It was designed by the", "truncated_answer"), ("It was lit (see the old", "truncated_answer"), ("{\"answer\": \"It was desi", "truncated_answer"),
        ("It was designed by Vemal Savahand, and the clerk added: \"the mill of", "truncated_answer"), ("There are three. First, the mill; second,", "truncated_answer"),
    ],
)
def test_defects(model, answer, kind):
    assert defects.defect(answer, Q, "Vemal Savahand", model) == kind


def test_foreign_names_asked_for(model):
    q = "What was the German name of the mill at Meger Charter?"
    assert defects.defect("die Brücke am Hafen Rokoholm", q, "die Brücke am Hafen Rokoholm", model) is None
    assert defects.defect("die Brücke am Hafen Rokoholm.", q, None, model) is None


def test_defect_table(spark):
    results = spark.createDataFrame(
        [(1, "q1", None, "unknown", "x"), (1, "q1", None, "unknown", "x"), (2, "q1", Q, "Vemal Savahand", "x"), (3, None, None, None, "x"), (4, "zz", None, "die Mühle ist es hier", "x")],
        "result_id long, question_id string, question string, raw_answer string, gold_answer string",
    )
    questions = spark.createDataFrame([("q1", Q, "Vemal Savahand"), ("q1", Q, "Vemal Savahand")], "question_id string, question string, gold_answer string").withColumn("ingested_at", F.current_timestamp())
    got = {r["result_id"]: r["defect_type"] for r in defects.found(results, questions, 100).collect()}
    assert got == {1: "refusal", 3: "empty_answer"}
    assert defects.found(results.limit(0), questions.limit(0)).count() == 0


# --- packing ---------------------------------------------------------------------------------------------------


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 60), max_size=25), st.integers(40, 64))
def test_plan_places_every_item_once(histogram, capacity):
    rows = packing.plan_packs(histogram, capacity)
    placed, filled = {}, {}
    for length, first, packs, each, container, offset in rows:
        assert first == placed.get(length, 0)
        placed[length] = first + packs * each
        for c in range(container, container + packs):
            assert offset == filled.get(c, 0)
            filled[c] = offset + length * each
    assert placed == histogram and all(v <= capacity for v in filled.values())
    assert sorted(filled) == list(range(len(filled)))
    assert sorted(capacity - v for v in filled.values()) == shortest_pack_first(histogram, capacity)


def shortest_pack_first(histogram, capacity):
    """What is left in each container when every item goes, longest first, into the one filled least."""
    left = []
    for n in sorted((k for k, v in histogram.items() for _ in range(v)), reverse=True):
        most = max(range(len(left)), key=left.__getitem__, default=None)
        if most is not None and left[most] >= n:
            left[most] -= n
        else:
            left.append(capacity - n)
    return sorted(left)


def test_shortest_pack_comes_first():
    rows = packing.plan_packs({60: 1, 55: 1, 40: 1}, 100)
    container = {length: c for length, _, _, _, c, _ in rows}
    assert container[40] == container[55] != container[60]  # best fit would put 40 beside 60


def test_pack_table(spark):
    random.seed(3)
    sizes = [random.choice([0, 1, 3, 5, 8, 13, 21, 55, 64, 5, 5, 5]) for _ in range(900)]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "item long, n_tokens int")
    got = packing.pack(rows, [(1, 20)]).collect()
    by_item, by_container = {}, {}
    for r in got:
        by_item.setdefault(r["item"], []).append((r["part"], r["length"]))
        if r["container"] is not None:
            by_container.setdefault(r["container"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in parts) == sizes[i] and [k for k, _ in sorted(parts)] == list(range(len(parts))) for i, parts in by_item.items())
    assert len(by_item) == 900 and all(len(p) == 1 for i, p in by_item.items() if sizes[i] <= 20)
    for spans in by_container.values():
        end = 0
        for offset, n in sorted(spans):
            assert offset == end
            end += n
        assert end <= 20
    assert sum(sizes) / (20 * len(by_container)) > 0.97
    assert packing.pack(rows.limit(0), [(1, 20)]).count() == 0


# --- mixing ----------------------------------------------------------------------------------------------------


def test_mix_shares_and_repeats(spark):
    random.seed(1)
    docs = [(i, random.choice([" Web", "web ", "web"]) if i % 3 else "books", "word " * random.randint(1, 30)) for i in range(3000)]
    docs += [(9000, None, "x"), (9001, "other", "x y"), (9002, "web", None)]
    documents = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumn("copies", F.lit(7))
    targets = spark.createDataFrame([("web", 0.3, 1.0), ("Books ", 0.6, 2.5), ("gone", 0.1, 9.0)], "source string, target_share double, max_repeats double")
    report = {r["source"]: r for r in mixing.mix_report(documents, targets).collect()}
    assert report["gone"]["mix_tokens"] == 0
    assert abs(report["web"]["actual_share"] - 1 / 3) < 0.005 and abs(report["books"]["actual_share"] - 2 / 3) < 0.005
    assert report["books"]["repeats"] <= 2.5 + 0.01 and report["web"]["repeats"] <= 1.0
    got = mixing.mix(documents, targets).collect()
    assert len({r["doc_id"] for r in got}) == len(got) and {r["source"] for r in got} == {"web", "books"}
    assert {r["copies"] for r in got if r["source"] == "books"} == {2, 3}
    small = mixing.mix(documents, targets, total_tokens=600).collect()
    assert abs(sum(r["n_tokens"] * r["copies"] for r in small) - 600) < 60
    assert mixing.mix(documents.limit(0), targets).count() == 0


# --- splitting -------------------------------------------------------------------------------------------------


def pieces(text, limit=40, overlap=8, least=10):
    splitter = splitting.Splitter(text, tokenizer())
    return splitter, splitter.pieces(limit, overlap, least)


TEXTS = [
    "\n\n".join(f"## Part {i}\nThe mill of Dr. Low was lit. " + "It ran for years, they say. " * 6 for i in range(6)),
    "x" * 900,
    "本文によると、旧桥の长さは五十メートル。" * 40,
    "word " * 500,
    "a\n\n\n\n\n" * 90,
    "नक्शे बंद है। हम चलते हैं। " * 30,
    "🙂🙃" * 120,
]


@pytest.mark.parametrize("text", TEXTS)
def test_pieces_fit_overlap_and_cover(text):
    splitter, found = pieces(text)
    chars = splitter.chars
    assert chars[found[0][0]] == 0 and chars[found[-1][1]] == len(text)
    end = None
    for start, stop, n in found:
        alone = tokenizer().count(text[chars[start] : chars[stop]])
        assert alone == n <= 40
        if end is not None:
            assert 0 < end - start <= 8 + 30 and stop > end
        end = stop


def test_pieces_cut_at_natural_boundaries():
    splitter, found = pieces(TEXTS[0], 60, 0, 5)
    ends = [TEXTS[0][: splitter.chars[b]] for _, b, _ in found[:-1]]
    assert all(e.rstrip().endswith((".", "\n")) or e.endswith("\n") for e in ends)


def test_split_table(spark):
    rows = spark.createDataFrame([(1, "word " * 120, 0), (2, "short", 0), (3, None, 0), (4, "", 0), (None, "y " * 90, 0)], "doc_id long, text string, piece_index int")
    got = splitting.split_documents(rows, [(7, 50, 5, 10)])
    texts = splitting.with_piece_text(got, rows.where("doc_id IS NOT NULL")).orderBy("piece_index").collect()
    assert "".join(r["piece"] for r in texts).startswith("word") and {r["doc_id"] for r in texts} == {1}
    assert {r["doc_id"] for r in got.collect()} == {1, None}
    assert splitting.split_documents(rows.limit(0), [(7, 50, 5, 10)]).count() == 0
    with pytest.raises(ValueError):
        splitting.split_documents(rows, [(7, 50, 26, 10)])


def test_token_boundaries():
    for text in ["plain text", "日本語 text", "🙂 ok", "", "a\ud800b"]:
        edges = tokenizer().boundaries(text)
        valid = edges[edges >= 0]
        assert valid[0] == 0 and valid[-1] == len(text) and (valid[1:] >= valid[:-1]).all()
