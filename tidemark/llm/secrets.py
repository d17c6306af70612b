"""Secret scans: candidates by pattern, then a random forest that removes the false ones.

The forest sees the candidate's length, character transitions and dictionary coverage, the
path of its document and the words beside it. The dictionary is that of the corpus: the commonest words that
stand on several sites. The forest is trained on labelled findings: those the
caller has, or a seeded set made from public formats of keys and of what is mistaken for them.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from heapq import merge

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import boosting, textkit
from .common import discard, settle, small_batches

# Public formats of credentials, and words that stand beside secrets or beside what isn't one.
FORMATS = {
    # without an END line, the key is what follows in whole lines of base64 or in runs that no word has the length of
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----|(?:\s+(?:[A-Za-z0-9+/=]{40,}|[A-Za-z0-9+/=]{16,}(?=[ \t]*\r?(?:\n|\Z))))*)",
    # a run of these characters has one place to begin at, so that it is walked once
    "jwt": r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "aws_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "github_token": r"\bgh[pousr]_[A-Za-z0-9]{36}\b",
    "slack_token": r"\bxox[abprs]-[A-Za-z0-9-]{10,}",
    "google_key": r"\bAIza[0-9A-Za-z_-]{35}\b",
    "stripe_key": r"\b[sr]k_(?:live|test)_[0-9A-Za-z]{16,}\b",
}
ASSIGNED = r"(?i:\b(?:password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key|auth|credential)s?\b[\"']?\s{0,3}(?::=|=>|[:=])\s{0,3}[\"']?)([^\s\"'<>,;]{6,})"
BARE = r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])"
SECRET_WORDS = frozenset("password passwd pwd passphrase secret token key apikey api_key access credential credentials auth bearer login aws private".split())
OTHER_WORDS = frozenset("sha sha1 sha256 md5 checksum digest hash commit revision uuid guid id isbn etag integrity serial build version image example sample placeholder".split())
SAFE_PATHS = ("test", "example", "sample", "doc", "fixture", "mock", "lock")
RISKY_PATHS = ("config", "env", "deploy", "settings", "secret", "prod", "credential")
DICTIONARY = tuple(
    "about access account admin after apple application assets authorization backup before build button cache change changeme class client cloud code common config connection content "
    "control country create current customer data database debug default delete description design development directory document download dummy email enable error event example "
    "export false field file first format function general group header hello history home https image import index input insert install integer interface internal issue language "
    "library license link list local login machine main manager master media message method model module monitor name network node none null number object option order output "
    "package page parent password path person placeholder please plugin policy private process product profile project property public query record release remote replace report "
    "request resource response result return root sample schema script search secret select sequence server service session setting simple source static status storage string style "
    "system table target template test text time title token true type undefined update upload user value version view volume website window with write your".split()
)

#: Score from which a candidate is a secret, and characters beside a candidate that are looked at.
SECRET_FROM = 0.5
BESIDE = 48
FEATURES = ("length", "entropy", "transitions", "digits", "uppers", "hex", "distinct", "coverage", "assigned", "formatted", "quoted", "secret_words", "other_words", "safe_path", "risky_path", "groups", "longest_run")

_FORMAT = re.compile("|".join(f"(?P<{name}>{form})" for name, form in FORMATS.items()))
_ASSIGNED, _BARE, _WORD = re.compile(ASSIGNED), re.compile(BARE), re.compile(r"[A-Za-z][A-Za-z0-9_]*")
_SAME = re.compile(r"(.)\1*", re.S)
_HEX = re.compile(r"[0-9a-fA-F-]+")
#: Words of the corpus that the dictionary holds at most, their least length, and the sites that a word must stand on.
DICTIONARY_WORDS, DICTIONARY_LETTERS, DICTIONARY_SITES = 20_000, 4, 3
#: Steps of a doubling into which words are sorted by their counts before the commonest are taken.
COUNT_STEPS = 8


class Dictionary:
    """Finds words inside a token: from left to right the longest at each place, none overlapping another."""

    def __init__(self, words: Iterable[str]):
        self.words = sorted(set(words))
        self._machine = None

    def __getstate__(self) -> dict:
        return {"words": self.words, "_machine": None}

    def coverage(self, own: str) -> float:
        """Share of the characters that lie in words."""
        if self._machine is None:
            self._machine = ahocorasick.Automaton()
            for w in self.words:
                self._machine.add_word(w, len(w))
            self._machine.make_automaton()
        return sum(n for _, n in self._machine.iter_long(own.lower())) / max(1, len(own))


PLAIN = Dictionary(w for w in DICTIONARY if len(w) >= DICTIONARY_LETTERS)


def dictionary(docs: DataFrame, site: str = "source") -> Dictionary:
    """The built-in words and the commonest of the corpus: runs of letters between other characters, counted over all texts.

    A word must stand on DICTIONARY_SITES sites, or on all if there are fewer, so that one page that many rows copy brings in none of its own. Equally
    common words go by name. Null and empty texts have no words.
    """
    cut = docs.select(F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"), F.explode(F.split(F.lower("text"), "[^a-z0-9]+")).alias("word"))
    words = cut.filter(F.col("word").rlike(f"^[a-z]{{{DICTIONARY_LETTERS},20}}$"))
    per_site = words.groupBy("word", "site").agg(F.count("*").alias("n"))
    common = per_site.groupBy("word").agg(F.sum("n").alias("n"), F.count("*").alias("sites"))
    sites = F.lit(min(DICTIONARY_SITES, docs.select(site).distinct().limit(DICTIONARY_SITES).count()))
    counted = settle(common.filter(F.col("sites") >= sites).select("word", "n", F.floor(F.log2("n") * COUNT_STEPS).alias("step")))
    # steps are some hundred at most; without them every partition would send its own DICTIONARY_WORDS to the driver
    least, held = 0, 0
    for step, size in sorted(counted.groupBy("step").count().collect(), reverse=True):
        least, held = step, held + size
        if held >= DICTIONARY_WORDS:
            break
    top = counted.filter(F.col("step") >= least).orderBy(F.desc("n"), "word").limit(DICTIONARY_WORDS)
    known = Dictionary([*PLAIN.words, *(r["word"] for r in top.select("word").collect())])
    discard(counted)
    return known


def _free(found: list[tuple[int, int, str]], taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The spans found that overlap none that is taken; both lists are in order."""
    out, k = [], 0
    for span in found:
        while k < len(taken) and taken[k][1] <= span[0]:
            k += 1
        if k == len(taken) or taken[k][0] >= span[1]:
            out.append(span)
    return out


def candidates(text: str) -> list[tuple[int, int, str]]:
    """Start, end and kind of every candidate, in order, none overlapping an earlier kind's: formats, assignments, bare tokens."""
    taken = [(m.start(), m.end(), m.lastgroup) for m in _FORMAT.finditer(text)]
    assigned = [(m.start(1), m.start(1) + len(m[1].rstrip(".)]}")), "assigned") for m in _ASSIGNED.finditer(text)]
    bare = [(m.start(), m.end(), "bare") for m in _BARE.finditer(text) if any(c.isdigit() for c in m.group())]
    for found in (assigned, bare):
        taken = list(merge(taken, _free(found, taken)))
    return taken


def describe(text: str, start: int, end: int, kind: str, path: str | None, known: Dictionary = PLAIN) -> list[float]:
    """FEATURES of one candidate."""
    own = text[start:end]
    n = max(1, len(own))
    shares = np.array(list(Counter(own).values())) / n
    classes = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in own]
    before, after = text[max(0, start - BESIDE) : start].lower(), text[end : end + BESIDE].lower()
    beside = [w for word in _WORD.findall(before)[-3:] + _WORD.findall(after)[:2] for w in (word, *word.split("_"))]
    where = (path or "").lower()
    return [
        float(n), float(-(shares * np.log2(shares)).sum()), sum(a != b for a, b in zip(classes, classes[1:])) / n,
        classes.count("d") / n, classes.count("u") / n, float(bool(_HEX.fullmatch(own))), len(shares) / n,
        known.coverage(own), float(kind == "assigned"), float(kind in FORMATS), float(text[start - 1 : start] in ("'", '"') if start else 0),
        float(any(w in SECRET_WORDS for w in beside)), float(any(w in OTHER_WORDS for w in beside)),
        float(any(w in where for w in SAFE_PATHS)), float(any(w in where for w in RISKY_PATHS)), float(own.count("-") + own.count("_")), max((len(m.group()) for m in _SAME.finditer(own)), default=0) / n,
    ]


def made_findings(rows: int = 3000, seed: int = 11) -> list[tuple[str, str, bool]]:
    """Labelled findings (text, path, secret or not), one candidate each: public formats with random bodies, and look-alikes."""
    rng = random.Random(seed)
    body = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    mixed, hexes = string.ascii_letters + string.digits, "0123456789abcdef"
    plain = [w for w in DICTIONARY if len(w) > 4]
    lower = string.ascii_lowercase

    def words(n: int) -> str:
        return " ".join(rng.choice(plain) if rng.random() < 0.5 else body(lower, rng.randint(2, 9)) for _ in range(n))

    def secret() -> str:
        name = rng.choice(["password", "passwd", "secret", "token", "api_key", "auth", "credential", "access_key"])
        sign, quote = rng.choice(["=", ": ", " = ", ":"]), rng.choice(["", '"', "'"])
        form = rng.randrange(6)
        if form == 0:
            return rng.choice(["AKIA", "ASIA"]) + body(string.ascii_uppercase + string.digits, 16)
        if form == 1:
            return rng.choice(["ghp_" + body(mixed, 36), "xoxb-" + body(string.digits, 11) + "-" + body(mixed, 24), "AIza" + body(mixed, 35), "sk_live_" + body(mixed, 24)])
        if form == 2:
            return "eyJ" + body(mixed, 20) + ".eyJ" + body(mixed, 40) + "." + body(mixed, 43)
        if form == 3:
            return "-----BEGIN PRIVATE KEY-----\n" + body(mixed + "+/", 64) + "\n-----END PRIVATE KEY-----"
        value = body(rng.choice([hexes, mixed, mixed + "!#%_-"]), rng.randint(10, 48))
        return f"{name}{sign}{quote}{value}{quote}"

    def other() -> str:
        form = rng.randrange(7)
        name = rng.choice(["password", "token", "secret", "auth", "api_key", "credential"])
        if form == 0:
            return rng.choice(["sha256 ", "commit ", "md5 ", "checksum ", "digest: ", "etag "]) + body(hexes, rng.choice([32, 40, 64]))
        if form == 1:
            return rng.choice(["uuid ", "id ", "guid ", ""]) + str(uuid.UUID(int=rng.getrandbits(128)))
        if form == 2:
            return name + rng.choice(["=", ": ", " = "]) + rng.choice(["changeme", "your_password_here", "xxxxxxxxxxxx", "placeholder", "undefined", "${PASSWORD}", "example123", "<password>", "********", "os.environ", "getpass()", "required", "function"])
        if form == 3:
            return name + rng.choice([": ", "="]) + rng.choice(plain) + rng.choice(["", "_", "."]) + rng.choice(plain)
        if form == 4:
            return rng.choice(["/", ""]) + "/".join(rng.choice(plain) for _ in range(4)) + "/" + str(rng.randint(1, 99)) + "/" + rng.choice(plain)
        if form == 5:
            return "_".join(rng.choice(plain) for _ in range(3)) + f"_v{rng.randint(1, 20)}_{rng.randint(1000, 9999)}"
        return rng.choice(["serial ", "isbn ", "build ", "version "]) + body(string.digits, rng.randint(20, 26))

    out = []
    while len(out) < rows:
        label = len(out) % 2 == 0
        text = f"{words(rng.randint(0, 6))} {secret() if label else other()} {words(rng.randint(0, 6))}".strip()
        roots = RISKY_PATHS if rng.random() < (0.4 if label else 0.15) else SAFE_PATHS if rng.random() < (0.1 if label else 0.35) else ("src", "web", "main")
        out.append((text, f"{rng.choice(roots)}{rng.randint(0, 40)}", label))
    return out


def train(findings: list[tuple[str, str, bool]], known: Dictionary = PLAIN) -> boosting.Trees:
    """A forest over the candidates of labelled findings; a finding without a candidate teaches nothing."""
    rows, labels = [], []
    for text, path, label in findings:
        for start, end, kind in candidates(text)[:1]:
            rows.append(describe(text, start, end, kind, path, known))
            labels.append(float(label))
    return boosting.forest(np.array(rows), np.array(labels))


def judged(text: str, path: str | None, model: boosting.Trees, known: Dictionary = PLAIN) -> list[tuple[int, int, str, float]]:
    """Start, end, kind and score of every candidate of a text."""
    found = candidates(text)
    if not found:
        return []
    votes = model.vote(np.array([describe(text, a, z, kind, path, known) for a, z, kind in found]))
    return [(a, z, kind, float(v)) for (a, z, kind), v in zip(found, votes)]


def _learned(docs: DataFrame, path: str, findings: list[tuple[str, str, bool]] | None, known: Dictionary | None):
    """The forest and the dictionary, some thousand nodes and DICTIONARY_WORDS words, for all tasks."""
    known = known or dictionary(docs, path)
    return docs.sparkSession.sparkContext.broadcast((train(findings or made_findings(), known), known))


_FOUND = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("kind", T.StringType()),
    T.StructField("sha256", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("is_secret", T.BooleanType()),
])


def scan(docs: DataFrame, path: str = "source", findings: list[tuple[str, str, bool]] | None = None, known: Dictionary | None = None) -> DataFrame:
    """doc_id, start, length (characters), kind, SHA-256 of the value, score and is_secret of every candidate in every whole text.

    Null and empty texts have no candidates; a null path tells nothing; repeated rows give repeated
    findings; a null doc_id stays null; an empty table gives no rows. Of overlapping candidates the first kind counts (formats,
    assignments, bare tokens). With a dictionary that was kept, a text's findings don't depend on the other texts. Texts are scanned whole where they are read, in time that grows with their length.
    """
    learned = _learned(docs, path, findings, known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, stop, _, _ in textkit.runs(batch.column(2)):
                rows = []
                for doc_id, where, text in zip(*(c.slice(first, stop - first).to_pylist() for c in batch.columns)):
                    for a, z, kind, v in judged(text or "", where, *learned.value):
                        rows.append((doc_id, a, z - a, kind, hashlib.sha256(text[a:z].encode("utf-8", "surrogatepass")).hexdigest(), v, v >= SECRET_FROM))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.bool_()))], names=_FOUND.names)

    return small_batches(docs.select(F.col("doc_id").cast("long"), F.col(path).cast("string").alias("path"), "text")).mapInArrow(run, _FOUND)


def redact(docs: DataFrame, path: str = "source", findings: list[tuple[str, str, bool]] | None = None, known: Dictionary | None = None) -> DataFrame:
    """``docs`` with every secret of ``text`` replaced by its kind in angle brackets; all else as it was, as in scan(). An empty table gives none."""
    learned = _learned(docs, path, findings, known)
    names = docs.columns
    text_at, path_at = names.index("text"), names.index(path)

    def clean(text: str | None, where: str | None) -> str | None:
        out, last = [], 0
        for a, z, kind, v in judged(text or "", where, *learned.value):
            if v >= SECRET_FROM:
                out += [text[last:a], f"<{kind}>"]
                last = z
        return text if not out else "".join([*out, text[last:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, stop, _, _ in textkit.runs(batch.column(text_at)):
                part = batch.slice(first, stop - first)
                texts = [clean(t, w) for t, w in zip(part.column(text_at).to_pylist(), part.column(path_at).cast(pa.string()).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(texts, batch.schema.field(k).type) if k == text_at else c for k, c in enumerate(part.columns)], names=names)

    return small_batches(docs).mapInArrow(run, docs.schema)
