"""Named entities of texts with their labels: a rule-based default, and the place where a recogniser plugs in.

A run of capitalised words (small words may join two of them) is a candidate. What it is called decides its label: cue
words at its end or begin, a title before it, a preposition of place; what no cue names is a person if it has two or
three words, else a place after such a preposition. The first word of a sentence counts only if another follows or if
it is capitalised elsewhere in the text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrion.functions.text import canonical_keyword, normalise_keyword

#: Labels that keywords are taken from (fixed values); dates, numbers, languages and peoples are left out.
KEPT_LABELS = ("PERSON", "ORG", "GPE", "LOC", "FAC", "PRODUCT", "WORK_OF_ART", "EVENT", "LAW")

Recogniser = Callable[[], Callable[[str], list[tuple[str, str]]]]

_LAST = {
    "ORG": "inc ltd llc corp corporation company council registry society committee university college bank foundation guild association agency ministry office institute party union club trust commission",
    "FAC": "bridge theatre theater archive lighthouse mill airport station tower quarry canal castle museum library hospital church chapel cathedral observatory foundry orchard ferry stadium school temple palace harbour road street",
    "LOC": "river lake sea ocean island islands mountain mountains valley bay cape desert forest peninsula coast hills",
    "EVENT": "war battle festival olympics championship cup revolution crisis conference games massacre earthquake",
    "LAW": "act treaty constitution code convention agreement charter lease accord ledger amendment statute regulation directive",
    "GPE": "city county state republic kingdom province district",
}
_FIRST = {"LOC": "lake mount river cape gulf", "GPE": "city republic kingdom province", "ORG": "university bank ministry", "LAW": "article section clause", "EVENT": "battle siege"}
_CUES = [{w: label for label, words in table.items() for w in words.split()} for table in (_LAST, _FIRST)]
_TITLES = frozenset("mr mrs ms dr prof sir lady lord king queen president saint st".split())
_PLACE = frozenset("in at near from to of".split())
_DROPPED = frozenset(
    """january february march april may june july august september october november december monday tuesday wednesday thursday friday
    saturday sunday english german french spanish italian latin greek russian chinese japanese arabic american british european""".split()
)
_SMALL = frozenset("a an the of and or de la von van in at on by for with to it he she they we i this that these those his her its their but if when while after before".split())
_TOKEN = re.compile(r"[^\W_][\w'’-]*|[.!?]|[“\"«]|[^\w\s]")
_QUOTED = re.compile(r"[“\"«]\s*([A-ZÀ-ÖØ-Þ][^”\"»\n]{2,80}?)\s*[”\"»]")


def _label(words: list[str], before: str, first: bool) -> str | None:
    """The label of a candidate; None if it is no entity."""
    low = [w.lower().rstrip("'’s") if w.endswith(("'s", "’s")) else w.lower() for w in words]
    if all(w in _DROPPED or w.isdigit() for w in low):
        return None
    if before in _TITLES or low[0] in _TITLES and len(low) > 1:
        return "PERSON"
    label = _CUES[0].get(low[-1]) or _CUES[1].get(low[0]) if len(low) > 1 else None
    if label:
        return label
    if any(c.isdigit() for c in low[-1]) and len(low) > 1:
        return "PRODUCT"
    if 2 <= len(low) <= 3:
        return "PERSON"
    if len(low) > 3:
        return "ORG"
    return "GPE" if before in _PLACE else None if first else "ORG" if words[0].isupper() and len(words[0]) > 1 else "PERSON"


def rule_recogniser() -> Callable[[str], list[tuple[str, str]]]:
    """Default recogniser: (text, label) of every entity, in order."""

    def recognise(text: str) -> list[tuple[str, str]]:
        out: list[tuple[str, str]] = []
        titled = {m.span(1) for m in _QUOTED.finditer(text) if sum(w[:1].isupper() for w in m.group(1).split()) > len(m.group(1).split()) / 2}
        out += [(text[a:b], "WORK_OF_ART") for a, b in sorted(titled)]
        run: list[re.Match] = []
        before, opens, starts = "", True, True

        def close() -> None:
            while run and run[-1].group().lower() in _SMALL:
                run.pop()
            while run and run[0].group().lower() in _SMALL:
                run.pop(0)
            if run:
                span = text[run[0].start() : run[-1].end()]
                label = _label([m.group() for m in run], before, starts and len(run) == 1)
                if label:
                    out.append((span, label))
            run.clear()

        word = ""
        for m in _TOKEN.finditer(text):
            token = m.group()
            capital = token[0].isupper()
            joined = bool(run) and text[run[-1].end() : m.start()].strip(" ") == ""
            if run and not joined:
                close()
            if capital or run and (token.lower() in ("of", "de", "von", "van") or token.isdigit()):
                if not run:
                    before, starts = word, opens
                run.append(m)
            elif run:
                close()
            opens = token in ".!?"
            word = token.lower() if token != "." else word
        close()
        return out

    return recognise


def entities(df: DataFrame, id_col: str, text_col: str, model: Recogniser | None = None) -> DataFrame:
    """(id, place, text, label) of every entity; a null text has none."""
    make = model or rule_recogniser

    @F.pandas_udf("array<struct<text:string,label:string>>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = make()
        for texts in batches:
            yield pd.Series([[{"text": t, "label": n} for t, n in run(x)] if isinstance(x, str) else [] for x in texts])

    rows = df.select(F.col(id_col), F.posexplode(find.asNondeterministic()(F.col(text_col))).alias("place", "e"))
    return rows.select(id_col, "place", "e.text", "e.label")


def entity_keywords(df: DataFrame, id_col: str, text_col: str, model: Recogniser | None = None, kept: tuple[str, ...] = KEPT_LABELS) -> DataFrame:
    """(id, keywords): sorted distinct canonical keywords of a text's entities of the kept labels; none gives an empty list."""
    found = entities(df, id_col, text_col, model).where(F.col("label").isin(*kept))
    words = found.select(id_col, F.nullif(canonical_keyword(normalise_keyword("text")), F.lit("")).alias("keyword"))
    lists = words.groupBy(F.col(id_col).alias("_id")).agg(F.array_sort(F.collect_set("keyword")).alias("keywords"))
    out = df.select(id_col).distinct().join(lists, F.col(id_col).eqNullSafe(F.col("_id")), "left")
    return out.select(id_col, F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"))
