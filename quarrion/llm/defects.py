"""Broken prompt and response pairs: one defect type per defective answer.

Order of the tests, the first that holds names the defect:

* ``empty_answer``: nothing but blanks, marks, markup or a label.
* ``question_copy``: answer and question are compressed, each with the other as raw zstandard dictionary. What the
  answer adds and what it leaves out, in bytes, go into a linear model that is fitted on copies made of sampled
  questions (whole, repeated, with words dropped or cut off) against those questions' answers. A copy must also
  repeat the word that asks, else it is a statement in the question's words.
* ``refusal``: a clause of the answer's own (outside quotations) in which a negation of a dictionary governs a verb of
  telling or knowing, said of the speaker or of the sources, and no answer after it.
* ``wrong_language``: own wording in another language than the question's, by function words and by the words of all
  questions of a language.
* ``truncated_answer``: a mark is left open or points onward, or the terminal-context model says that a text does not
  end so. The model is a logistic regression over the last words, their endings and their shapes, fitted on answers
  that are known to be complete (they end in a stop) against the same answers cut at random places.

Both models are fitted on a bounded sample of answers (about ``FIT_ROWS``, of a hash below a threshold); words are
counted over all questions; every row is judged.

A null raw answer is empty. An answer whose question is null in both tables is judged without it. Repeated rows of
a result give one row. Texts are judged whole.
"""

from __future__ import annotations

import html
import random
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrion.session import checkpointed, spread

#: Answers that the models are fitted on, about; questions that copies are made of, and words kept of a language, at most.
FIT_ROWS, COPY_ROWS, MOST_WORDS = 20_000, 1_500, 20_000

_LABEL = regex.compile(
    r"^[\s*_#>\"'“”]*(?:the |final |short |my |correct )*(?:answer|response|reply|result|output|a|antwort|endgültige antwort|réponse(?: finale)?"
    r"|reponse|respuesta(?: final)?|risposta|答案|回答|答え|答|उत्तर|الجواب|الإجابة|คำตอบ)[\s*_]*[:：=][\s*_\"'“”]*",
    regex.I,
)
_COPY_LABEL = regex.compile(
    r"\b(?:question|q|you asked|the question (?:was|is)|prompt|frage|question posée|pregunta|answer|final answer|a|antwort|réponse|respuesta)\s*[:：]", regex.I
)
_MARKUP = regex.compile(r"<[^<>]*>|&[a-zA-Z#0-9]+;|\\[nrt]")
_JSON, _JSON_END = regex.compile(r"^\s*\{\s*\"(?:answer|response|output|result)\"\s*:\s*\""), regex.compile(r"\"\s*\}\s*$")
_JSON_OPEN, _JSON_WORD = regex.compile(r"^\s*\{\s*\"\w+\"\s*:\s*\""), regex.compile(r"\"answer\"\s*:\s*\"\s*\w")
_CLAUSE_WORD = regex.compile(r"n't|[\p{L}\p{M}\p{N}]+")
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_QUOTED = regex.compile(r"“[^”]*”|„[^“”]*[“”]|«[^»]*»|「[^」]*」|『[^』]*』|\"[^\"]*\"|(?<!\w)'[^']*'(?!\w)|‘[^’]*’")
#: Words that ask, in the languages of the questions.
_INTERROGATIVES = set(
    """who whom whose what which when where why how did does is wer wen wem was wann wo warum wie welche welcher welchem welchen
    qui que quoi quand où comment pourquoi combien quel quelle quels quelles quién qué cuándo dónde cómo cuál cuántos cuántas""".split()
)
_NONLATIN = regex.compile(r"[\p{L}--\p{Latin}]", regex.V1)

#: Function words by language, by which wording is told apart.
FUNCTION_WORDS = {
    "en": """the a an of and or in on at to for from by with about as is are was were be been being has have had do does did
        not no this that these those it its he she they them his her their who whom whose which what when where why how
        if then than but because so into under over after before between during until while there here also such only
        can could may might must shall should will would says said i you we my your our any all some each more most
        yes""",
    "de": """der die das den dem des ein eine einen einem einer eines und oder aber in im ins am an auf aus bei beim mit nach
        von vom vor zu zum zur über unter durch für gegen ohne um ist sind war waren wird werden wurde wurden hat haben
        hatte sein seine seinem seinen ihr ihre nicht kein keine dass weil wenn als wie es er sie wir man sich auch nur
        noch schon hier dort da dabei danach damals daher dazu laut wer was wann wo
        warum welche welcher welchem welchen jahr seit bis dieser diese dieses also somit""",
    "fr": """le la les l un une des du de d et ou mais dans en au aux à sur sous par pour avec sans chez est sont était étaient
        fut furent a ont avait qui que qu quoi dont où quand comment pourquoi ce cet cette ces c il elle ils elles on se s
        son sa ses leur leurs ne n pas plus comme si parce donc ainsi ensuite depuis selon après avant entre lors il'
        ici quelle quel quels quelles y""",
    "es": """el la los las un una unos unas de del y o pero en al a con por para sin sobre entre desde hasta es son era eran fue
        fueron ha han había que quién quien qué cuál cuándo dónde cómo por porque cuando donde como si no se su sus lo le
        les este esta estos estas eso aquí ahí según después antes durante más muy también ya
        cuántos cuántas""",
}
_LANGUAGES = {lang: set(words.split()) for lang, words in FUNCTION_WORDS.items()}

#: Refusals: dictionaries by language. ``deny`` are negations, ``tell`` verbs of telling and knowing (by their stems),
#: ``who`` the speaker and the sources, ``lack`` words that deny by themselves when said of a source or of ``proof``,
#: ``decline`` those that do when said of the speaker; ``alone`` are whole answers.
REFUSALS = {
    "en": {
        "deny": "not cannot n't never nothing none no nobody neither unable impossible without hardly rather",
        "tell": """know say tell answer mention state stating specif provid contain includ cover discuss address settl support giv given
            find finds found$ indicat reveal explain determin infer establish conclu deriv verif help assist comply comment disclos
            speculat sure identif locat confirm decid resolv information evidence enough sufficient detail knowledge idea""",
        "who": """i we me us my our passage passages context contexts text texts document documents source sources excerpt excerpts
            material materials records information evidence""",
        "lack": "lack lacks lacking insufficient inadequate missing unavailable unanswerable undetermined unclear unspecified unstated omit omits unanswered unsettled",
        "proof": "evidence information detail details data context passages passage text source sources facts knowledge",
        "decline": "decline declining refuse refusing unable prevent prevents forbid forbids abstain pass",
        "alone": "unknown|n a|na|not available|no answer|none given|no idea|unclear|undetermined|unanswerable|not sure|not known|no comment|not found|nothing found|not stated|not specified|not given|not mentioned|not provided|no information",
    },
    "de": {
        "deny": "nicht nichts kein keine keinen keinem keiner nie niemals leider unmöglich ohne weder",
        "tell": "wei\u00df weiss wiss sag beantwort antwort erwähn genannt nenn angegeb angab enthalt enthält bestimm hervor auskunft helf find feststell klär ableit beurteil information ahnung hinweis angabe",
        "who": "ich wir mir uns mich abschnitt abschnitte absätze absatz text texte texten quelle quellen dokument dokumente passagen kontext sich",
        "lack": "unbekannt unklar unzureichend fehlt fehlen ungenügend",
        "proof": "information informationen angabe angaben beleg belege hinweis hinweise text quelle quellen",
        "decline": "ablehnen verweigere außerstande enthalte",
        "alone": "unbekannt|keine angabe|keine angaben|nicht bekannt|keine ahnung|keine antwort|unklar|keine information",
    },
    "fr": {
        "deny": "pas ne n aucun aucune rien jamais impossible sans insuffisant insuffisante insuffisantes ni",
        "tell": "sai sav répond dire dis dit dise précis mention indiqu parl contien contenu donn permet aid détermin trouv réponse information indication établ conclu idée vérifi fourni",
        "who": "je j nous me m moi passage passages texte textes contexte document documents source sources extrait extraits on",
        "lack": "insuffisant insuffisante insuffisantes insuffisants manque manquent inconnu inconnue",
        "proof": "information informations indication indications preuve preuves contexte texte source sources détail détails",
        "decline": "refuse décline abstiens incapable",
        "alone": "inconnu|inconnue|aucune idée|pas de réponse|sans réponse|non précisé|non précisée|non mentionné|aucune information",
    },
    "es": {
        "deny": "no nada ningún ninguna ninguno nunca tampoco imposible sin ni",
        "tell": "sé sabe sab responder decir dic dig indic mencion especific contien precis aclar información dato ayud determin encontr posible verific conclu permit proporcion consta",
        "who": "yo nosotros me nos mi pasaje pasajes texto textos contexto documento documentos fuente fuentes puedo podemos puede sé hay",
        "lack": "insuficiente insuficientes falta faltan desconocido desconocida desconoce",
        "proof": "información datos dato prueba pruebas contexto texto fuente fuentes detalle",
        "decline": "rechazo declino niego abstengo",
        "alone": "desconocido|desconocida|se desconoce|sin respuesta|no se sabe|no consta|ni idea|sin datos",
    },
}
_DENY, _WHO, _LACK, _PROOF, _DECLINE = ({lang: frozenset(d[key].split()) for lang, d in REFUSALS.items()} for key in ("deny", "who", "lack", "proof", "decline"))
_TELL = {lang: regex.compile("(?:" + "|".join(d["tell"].split()) + ")") for lang, d in REFUSALS.items()}
_ALONE = {phrase for d in REFUSALS.values() for phrase in d["alone"].split("|")}
_IDIOM = regex.compile(r"\bleav\w+ (?:\w+ ){0,3}(?:open|unanswered|unresolved)\b|\b(?:offen|unbeantwortet) (?:lassen|bleib)|\breste(?:nt)? sans réponse\b|\bqueda sin\b|\bno (?:\w+ )?answer (?:can|could|is|was|in|from)\b|\bkeine antwort\b|\b(?:pas de|aucune) réponse\b|\bsin respuesta\b")
#: An answer in one word, which denies nothing.
_VERDICT = regex.compile(r"(?:^|[:\s])(?:no|yes|nein|ja|non|oui|sí|si)\s*[,.:;!]")
#: Words between a negation and what it denies, at most.
_REACH = 7
_CLAUSE = regex.compile(r"[.;:!?\n]+|(?<=[\p{L}\p{N}])\s*,(?=\s*(?:but|yet|so|and|aber|doch|mais|pero|sino)\b)")
#: A clause that gives an answer after all.
_CONTRAST = regex.compile(r"(?:[,;]\s*|^\s*|\.\s+)(?:but|yet|however|still|nevertheless|aber|jedoch|doch|mais|cependant|pero|sin embargo)\b[^.]*[\p{Lu}\p{N}]")

_STATED = regex.compile(r"\n\s*(?:the )?(?:final )?(?:answer|antwort|réponse|respuesta)\s*[:：]", regex.I)
_STOP = regex.compile(r"[.!?。！？।॥؟…]$")
_REFERENCE = regex.compile(r"(?:\s*\[\d{1,3}\])+$")
_FOREIGN_ASKED = regex.compile(
    r"\b(?:german|french|spanish|english|italian|latin)\b[^?]{0,40}\b(?:name|letters?|word|term|called|title|refer)|\b(?:name|letters?|word|term|title)\b[^?]{0,20}\b(?:german|french|spanish)\b"
    r"|\b(?:deutsche|französische|spanische|englische)\w* (?:name|bezeichnung|wort)|\bnom (?:allemand|français|espagnol|anglais)|\bnombre (?:alemán|francés|español|inglés)",
    regex.I,
)
_FOREIGN_PHRASE = regex.compile(
    r"\b(?:der|die|das|le|la|les|el|los|las|l['’]|the)(?:\s+[\p{Ll}\p{Lu}][\p{L}]*){1,4}?\s+\p{Lu}\p{Ll}+|^\W*(?:der|die|das|le|la|el)\s+[\p{L} ]{3,40}\W*$"
)


def normal(text: str) -> list[str]:
    """Case-folded words after NFKC."""
    return _WORD.findall(unicodedata.normalize("NFKC", text).casefold())


def visible(text: str) -> str:
    """``text`` after NFKC without invisible characters."""
    if text.isascii() and text.isprintable():
        return text
    return "".join(c for c in unicodedata.normalize("NFKC", text) if unicodedata.category(c) not in ("Cf", "Cc", "Co", "Cn") or c in "\n\t\r")


def strip_labels(text: str) -> str:
    """``text`` without markup and leading answer labels."""
    text = html.unescape(text)
    text = _MARKUP.sub(" ", text).strip()
    json = _JSON.match(text)
    if json:
        text = _JSON_END.sub("", text[json.end() :])
    while True:
        label = _LABEL.match(text)
        if not label or label.end() == 0:
            return text.strip()
        text = text[label.end() :]


def without(text: str, part: str) -> str:
    """``text`` without ``part``, whatever the case."""
    low, sought = text.lower(), part.lower()
    if len(low) != len(text):  # some letter has another length in lower case
        return text.replace(part, " ")
    at = low.find(sought)
    while at >= 0:
        text, low = text[:at] + " " + text[at + len(part) :], low[:at] + " " + low[at + len(part) :]
        at = low.find(sought, at + 1)
    return text


def language_of(words: list[str]) -> str | None:
    """The language of which most function words occur; None if none does."""
    score = {lang: sum(w in known for w in words) for lang, known in _LANGUAGES.items()}
    best = max(score, key=lambda k: score[k])
    return best if score[best] else None


_SIZES = zstandard.ZstdCompressionParameters(
    compression_level=3, window_log=14, hash_log=10, chain_log=10, search_log=4, min_match=3, target_length=32,
    strategy=zstandard.STRATEGY_BTOPT, write_content_size=0, write_dict_id=0,
)
_EMPTY = len(zstandard.ZstdCompressor(compression_params=_SIZES).compress(b""))


def added_bytes(text: bytes, known: bytes) -> int:
    """Compressed size of ``text`` with ``known`` as raw dictionary: what the one adds to the other."""
    held = zstandard.ZstdCompressionDict(known, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return len(zstandard.ZstdCompressor(compression_params=_SIZES, dict_data=held).compress(text)) - _EMPTY


def copy_features(said: list[str], asked: list[str]) -> list[float] | None:
    """What the answer adds to the question and leaves out of it, in bytes and as shares; None if one is too short."""
    answer, question = " ".join(said).encode(), " ".join(asked).encode()
    if len(asked) < 3 or len(said) < 3 or len(answer) < 0.5 * len(question):
        return None  # so short an answer can't repeat the question
    new, lost = added_bytes(answer, question), added_bytes(question, answer)
    again = 3 * (max(1, round(len(answer) / len(question))) - 1)  # a repetition is one more match
    return [1.0, max(0, new - lost - again) / 3, 10 * new / len(answer), 10 * lost / len(question)]


def logistic(rows: np.ndarray, labels: np.ndarray, rounds: int = 400, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a logistic regression by Newton steps."""
    weights = np.zeros(rows.shape[1])
    for _ in range(min(rounds, 25)):
        chance = 1 / (1 + np.exp(-np.clip(rows @ weights, -30, 30)))
        slope = rows.T @ (chance - labels) / len(rows) + ridge * weights
        curve = (rows * (chance * (1 - chance))[:, None]).T @ rows / len(rows) + ridge * np.eye(len(weights))
        weights -= np.linalg.solve(curve, slope)
    return weights


def fit_copies(pairs: list[tuple[str, str]], seed: int = 5) -> np.ndarray | None:
    """Weights of the copy model, from (question, gold answer) pairs: what a copy is like is made from the questions,
    what an answer after the question is like from the answers. None without any pair."""
    rng = random.Random(seed)
    rows, labels = [], []
    for question, gold in pairs:
        asked, answer = normal(question), normal(gold)
        if len(asked) < 4 or not answer or set(answer) <= set(asked):
            continue
        least = {w for w in asked if any(w in words for words in _LANGUAGES.values()) and w not in _INTERROGATIVES}
        k = rng.randrange(1, len(asked))
        one = rng.choice([i for i, w in enumerate(asked) if w in least] or [k])
        typo = [w if i != k else w[:-2] + w[-1:] + w[-2:-1] for i, w in enumerate(asked)]
        copies = [asked, asked + asked, asked + asked[: len(asked) - 1], [w for w in asked if w not in least], asked[:k] + asked[k + 1 :], asked[:one] + asked[one + 1 :], asked[:-1] + [asked[-1][:-2] or asked[-1]], typo]
        others = [asked + answer, asked + [str(rng.randrange(10, 100))], asked + [rng.choice(("yes", "no", asked[k]))], answer + asked, asked[k:] + answer, asked[: len(asked) // 2] + answer, asked[len(asked) // 2 :]]
        for words, label in [(w, 1.0) for w in copies] + [(w, 0.0) for w in others]:
            features = copy_features(words, asked)
            if features:
                rows.append(features)
                labels.append(label)
    return logistic(np.array(rows), np.array(labels)) if rows else None


def is_copy(answer: str, question: str, gold: list[str], weights: np.ndarray | None) -> bool:
    """Whether ``answer`` only repeats ``question``, wholly or nearly: the model proposes, words are checked after it."""
    asked, said = normal(question), normal(_COPY_LABEL.sub(" ", answer))
    features = copy_features(said, asked)
    if features is None or weights is None or float(np.dot(features, weights)) <= 0:
        return False
    if gold and said[len(asked) :] == gold and said[: len(asked)] == asked:
        return False  # the question, and the answer after it
    if any(w[0].isdigit() and w not in asked for w in said):
        return False  # a number that the question lacks
    asking = next((w for k, w in enumerate(asked) if w in _INTERROGATIVES and not (w == "was" and k)), None)  # without it, it is a statement in the question's words
    return asking in said if asking else said[0] == asked[0]


def shape(word: str, lang: str) -> str:
    """A word as its class: a number, a name, a function word (itself), or any other."""
    if word[0].isdigit():
        return "9"
    if word[0].isupper():
        return "N"
    return word if word in _LANGUAGES[lang] else "w"


def end_features(text: str, lang: str, asked: list[str], gold: list[str]) -> list[str]:
    """The terminal context of ``text``: last words, their endings and shapes, and how they stand to question and gold answer."""
    words = _WORD.findall(text)[-6:]
    if not words:
        return []
    last, low = words[-1], words[-1].lower()
    marked = "^" + low
    shapes = [shape(w, lang) for w in words]
    out = [f"{lang}w {low}", f"{lang}c {shapes[-1]}", f"{lang}n {len(words)} {last[0].isupper()}"]
    out += [f"{lang}e {marked[-k:]}$" for k in (2, 3, 4, 5) if len(marked) >= k]
    out += [f"{lang}l {min(len(low), 9)} {shapes[-1][0]}"]
    out += [f"{lang}x {' '.join(shapes[-k:])}" for k in (2, 3, 4, 5) if len(shapes) >= k]
    if len(words) > 1:
        out += [f"{lang}p {words[-2].lower()} {shapes[-1]}"]
    if gold:
        tail = [w.lower() for w in words[-len(gold) :]]
        if tail == gold[-len(tail) :] and len(tail) == min(len(gold), len(words)):
            out += ["gold whole", f"gold whole {min(len(words), 5)}"]
        elif any(tail[-k:] == gold[:k] for k in range(1, min(len(gold), len(tail) + 1))):
            out.append("gold begun")
        elif tail and any(g.startswith(tail[-1]) and g != tail[-1] for g in gold):
            out.append("gold cut")
        else:
            inside = " ".join(gold) in " ".join(normal(text))
            out += [f"gold apart {inside}", f"gold apart {inside} {bool(asked) and low == asked[-1]}"]
    return out


@dataclass
class Models:
    """What is fitted before rows are judged."""

    #: Weights of ``copy_features``, of ``end_features``, and the words of questions by language.
    copies: np.ndarray | None = None
    ends: dict[str, float] = field(default_factory=dict)
    native: dict[str, frozenset[str]] = field(default_factory=dict)

    def ended(self, text: str, lang: str, asked: list[str], gold: list[str]) -> float:
        """Log odds that a text which ends so is complete."""
        return sum(self.ends.get(f, 0.0) for f in end_features(text, lang, asked, gold)) + self.ends.get("", 0.0)


def fit_ends(rows: list[tuple[str, str, list[str], list[str]]], seed: int = 11, rounds: int = 4) -> dict[str, float]:
    """Weights of the terminal-context model from (complete answer without its stop, language, words of the
    question and of the gold answer).

    Every answer is an example of an end, and gives two of no end: cut between words and inside a word. A cut where
    the text could have ended (before a mark, or right after the gold answer) is none.
    """
    rng = random.Random(seed)
    examples: list[tuple[list[str], float]] = []
    for text, lang, asked, gold in rows:
        examples.append((end_features(text, lang, asked, gold), 1.0))
        spots = [m for m in _WORD.finditer(text)]
        if len(spots) < 4:
            continue
        for inside in (False, True, False):
            spot = spots[rng.randrange(2, len(spots))]
            cut = text[: rng.randrange(spot.start() + 1, spot.end())] if inside and spot.end() - spot.start() > 2 else text[: spot.start()].rstrip()
            if not cut or not _WORD.search(cut[-1]) or (gold and normal(cut)[-len(gold) :] == gold):
                continue
            examples.append((end_features(cut, lang, asked, gold), 0.0))
    counts = Counter(f for features, _ in examples for f in features)
    names = {f: k for k, f in enumerate(f for f, n in counts.items() if n >= 2)}
    weights, squares = np.zeros(len(names) + 1), np.full(len(names) + 1, 1e-3)
    rng.shuffle(examples)
    coded = [(np.array([names[f] for f in features if f in names] + [len(names)]), label) for features, label in examples]
    for _ in range(rounds):
        for lo in range(0, len(coded), 256):
            part = coded[lo : lo + 256]
            sizes = np.array([len(x) for x, _ in part])
            at = np.concatenate([x for x, _ in part])
            sums = np.add.reduceat(weights[at], np.cumsum(sizes) - sizes)
            error = 1 / (1 + np.exp(-np.clip(sums, -30, 30))) - np.array([y for _, y in part])
            slope = np.bincount(at, np.repeat(error, sizes), len(weights))
            squares += slope * slope
            weights -= 0.5 * slope / np.sqrt(squares)
    out = {f: round(float(weights[k]), 3) for f, k in names.items() if abs(weights[k]) > 0.05}
    out[""] = float(weights[-1])
    return out


def unclosed(text: str) -> bool:
    """Whether a quotation or bracket is open at the end."""
    for left, right in (("(", ")"), ("[", "]"), ("{", "}"), ("«", "»"), ("「", "」"), ("『", "』"), ("（", "）")):
        if text.count(left) > text.count(right):
            return True
    if text.count("“") + text.count("„") > text.count("”") + (min(text.count("“"), text.count("„")) if "„" in text else 0):
        return True
    return text.count('"') % 2 == 1


#: Log odds below which a text is taken to go on.
END_ODDS = 0.0


def is_truncated(raw: str, core: str, asked: list[str], gold: list[str], lang: str, models: Models) -> bool:
    """Whether ``core`` stops before its statement is complete."""
    text = _REFERENCE.sub("", core.rstrip()).rstrip()
    marked = len(text) < len(core.rstrip())
    if _JSON_OPEN.match(raw) and not raw.rstrip().endswith("}"):
        return True
    if not text:
        return False
    if unclosed(text):
        return True
    text = _STATED.split(text)[-1].strip() or text  # after steps, what is stated as the answer counts
    bare = text.rstrip("*_\"'”’»)」』)】 ")
    if not bare:
        return False
    if bare[-1] in ",;:–—-/&(+=":
        return True
    if bare.endswith(("...", "…")):
        return len(normal(bare)) > 3
    if _STOP.search(bare) or marked:
        return False
    said = normal(bare)
    if said == gold or len(said) < (2 if gold else 3):
        return False
    return models.ended(bare, lang, asked, gold) < END_ODDS


def _denies(clause: list[str]) -> bool:
    """Whether the words of a clause decline to answer, in any of the languages."""
    known = set(clause)
    for lang, deny in _DENY.items():
        who = _WHO[lang] & known
        if _LACK[lang] & known and _PROOF[lang] & known or who and _DECLINE[lang] & known:
            return True
        if not who and not (len(clause) <= 8 and _PROOF[lang] & known):
            continue
        tell = _TELL[lang]
        for k, word in enumerate(clause):
            if word in deny and any(tell.match(w) for w in clause[k + 1 : k + 1 + _REACH]):
                return True
            if lang == "de" and word in deny and any(tell.match(w) for w in clause[max(0, k - _REACH) : k]):
                return True
    return False


def is_refusal(text: str, gold: list[str]) -> bool:
    """Whether ``text`` declines, outside quotations and without an answer after all."""
    own = _QUOTED.sub(" “” ", text).lower().replace("’", "'").replace("n't", " n't").replace("can not", "cannot")
    if " ".join(_WORD.findall(own)) in _ALONE:
        return True
    parts = _CLAUSE.split(own)
    for k, part in enumerate(parts):
        words = [w.strip("'") or w for w in _CLAUSE_WORD.findall(_VERDICT.sub(" ", part))]
        if " ".join(words) in _ALONE or _denies(words) or _IDIOM.search(part):
            rest = own[own.index(part) + len(part) :] if k + 1 < len(parts) else ""
            return not (_CONTRAST.search(text[len(text) - len(rest) :] if rest else "") or len("".join(gold)) > 3 and " ".join(gold) in " ".join(normal(rest)))
    return False


def is_foreign(text: str, question: str, gold: str | None, lang: str | None, native: set[str] | None = None) -> bool:
    """Whether the answer's own wording is in another language than the question."""
    own = _QUOTED.sub(" ", text)
    if len(_NONLATIN.findall(own)) >= 2 and len(_NONLATIN.findall(question)) < 2:
        return True
    if not lang:
        return False
    if gold and len(gold.strip()) > 2:
        own = without(own, gold.strip())
    if _FOREIGN_ASKED.search(question):
        own = _FOREIGN_PHRASE.sub(" ", own, count=1)
    known_names = {w for w in _WORD.findall(question)}
    words = [w for w in _WORD.findall(own.replace("’", " ").replace("'", " ")) if not (w in known_names and w[0].isupper())]
    lower = [w.lower() for k, w in enumerate(words) if w[0].islower() or w.lower() in _LANGUAGES["de"] or k == 0 and w[0].isalpha()]
    mine = _LANGUAGES[lang]
    home = sum(w in mine and sum(w in known for known in _LANGUAGES.values()) == 1 for w in lower)
    for other, known in _LANGUAGES.items():
        if other == lang:
            continue
        strange = [w for w in lower if w in known and w not in mine]
        if len(strange) >= 2 and len(strange) > 2 * home:
            return True
        if strange and native and len(lower) >= 2 and sum(w in mine or w in native for w in lower) <= 0.25 * len(lower):
            return True
        if strange and home == 0 and sum(w[0].islower() for w in words) >= 2 and sum(w in known for w in lower) >= 2:
            return True
    return False


def defect(raw: str | None, question: str | None, gold: str | None, models: Models) -> str | None:
    """The defect type of one answer, None if it is a proper one."""
    if raw is None:
        return "empty_answer"
    text = visible(raw)
    core = strip_labels(text)
    if not _WORD.search(core):
        return "truncated_answer" if _JSON_WORD.search(text) else "empty_answer"
    want = normal(gold or "")
    if want and want != ["unknown"] and normal(core) == want and not core.rstrip().endswith((",", ";", ":", "-")):
        return None
    asked = question or ""
    if asked and is_copy(core, asked, want, models.copies):
        return "question_copy"
    if is_refusal(core, want):
        return "refusal"
    lang = language_of(normal(asked)) if asked else None
    if asked and is_foreign(core, asked, gold, lang, models.native.get(lang or "")):
        return "wrong_language"
    own = lang or language_of(normal(core)) or "en"
    return "truncated_answer" if is_truncated(text, core, normal(asked), want, own, models) else None


def answered(results: DataFrame, questions: DataFrame) -> DataFrame:
    """(result_id, raw_answer, question, gold) of every result row; the question of ``questions`` where its own is null."""
    asked = questions.where("question_id IS NOT NULL").groupBy("question_id").agg(
        F.max_by(F.struct("question", "gold_answer"), F.struct("ingested_at", F.xxhash64("question", "gold_answer"))).alias("q")
    )
    rows = results.select("result_id", "question_id", "question", "raw_answer").join(asked, "question_id", "left")
    return rows.select("result_id", "raw_answer", F.coalesce("question", "q.question").alias("question"), F.col("q.gold_answer").alias("gold"))


def sampled(rows: DataFrame, key: str, size: int) -> DataFrame:
    """About ``size`` rows, those whose hash of ``key`` is below a threshold taken from the count; all if there are fewer."""
    total, steps = rows.count(), 1 << 30
    if total <= size:
        return rows
    return rows.where(F.pmod(F.xxhash64(key), F.lit(steps)) < int(steps * size / total)).limit(2 * size)


def question_words(questions: DataFrame, most: int = MOST_WORDS) -> dict[str, frozenset[str]]:
    """The ``most`` words that most of the different questions of each language have, by the language of their function words."""

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts: Counter = Counter()
            for question in batch["question"]:
                found = normal(question)
                lang = language_of(found)
                if lang:
                    counts.update((lang, w) for w in set(found))
            yield pd.DataFrame([(lang, w, n) for (lang, w), n in counts.items()], columns=["lang", "word", "n"])

    counted = questions.select("question").where("question IS NOT NULL").distinct().mapInPandas(words, "lang string, word string, n bigint")
    counted = checkpointed(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")))
    found: dict[str, set[str]] = {}
    for lang in _LANGUAGES:
        rows = counted.where(F.col("lang") == lang).orderBy(F.desc("n"), "word").limit(most).collect()
        found[lang] = {r["word"] for r in rows}
    return {lang: frozenset(words) for lang, words in found.items()}


def fit_models(rows: DataFrame, questions: DataFrame, fit_rows: int = FIT_ROWS) -> Models:
    """All models, from ``answered`` rows; see the module's docstring for what each is fitted on."""
    sample = sampled(rows.where("raw_answer IS NOT NULL"), "result_id", fit_rows).toPandas()
    ends, copies = [], {}
    for answer, question, gold in zip(sample["raw_answer"], sample["question"], sample["gold"], strict=True):
        core = strip_labels(visible(answer))
        asked = question if isinstance(question, str) else ""
        want = normal(gold) if isinstance(gold, str) else []
        lang = language_of(normal(asked)) or language_of(normal(core)) or "en"
        if asked and want and len(copies) < COPY_ROWS:
            copies[asked] = gold
        body = _REFERENCE.sub("", core).rstrip("*_\"'”’»)」 ")
        if _STOP.search(body) and not unclosed(body) and not is_foreign(body, asked, gold, lang) or normal(body) == want:
            ends.append((_STOP.sub("", body).rstrip(" .!?…"), lang, normal(asked), want))
    return Models(fit_copies(list(copies.items())), fit_ends(ends), question_words(questions))


def found(results: DataFrame, questions: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """p1_found: (result_id, defect_type) of every defective result."""
    rows = checkpointed(answered(results.where("result_id IS NOT NULL"), questions))
    models = fit_models(rows, questions.select("question").unionByName(rows.select("question")), fit_rows)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        text = lambda x: x if isinstance(x, str) else None
        for batch in batches:
            kinds = [
                defect(text(a), text(q), text(g), models)
                for a, q, g in zip(batch["raw_answer"], batch["question"], batch["gold"], strict=True)
            ]
            out = pd.DataFrame({"result_id": batch["result_id"], "defect_type": kinds})
            yield out[out["defect_type"].notna()]

    rows = spread(rows)
    return rows.mapInPandas(judge, "result_id bigint, defect_type string").groupBy("result_id").agg(F.min("defect_type").alias("defect_type"))
