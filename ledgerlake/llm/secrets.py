"""Secret scans: candidate strings, judged by a random forest trained from labelled findings.

What natural text looks like (character transitions, a dictionary) is learned from the whole corpus; the forest is
fitted by Spark's MLlib, and its trees are walked with numpy in the tasks that find the candidates.
"""

from __future__ import annotations

import random
import re
import string
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, shared_dir, written

#: A candidate is a run of at least this many characters that keys are made of, or a run of any length where a value
#: stands (after a sign or a quote). '=' belongs to it as padding at its end only.
MIN_LENGTH = 8
_KEY = r"[A-Za-z0-9+/_-]"
_RUN = re.compile(rf"(?<!{_KEY})(?:{_KEY}{{{MIN_LENGTH},}}|(?:(?<=[=:\"'`])|(?<=[=:] )){_KEY}+)(?:={{1,2}}(?![A-Za-z0-9+/_=\"'`-]))?")
_NEIGHBOURS = 48
#: Findings that the forest is trained from, made by labelled_findings.
N_FINDINGS = 4000
#: Words of the dictionary: the corpus' commonest of 4 to 12 letters.
MAX_WORDS = 20_000
SHORTEST, LONGEST = 4, 12
FEATURES = ["length", "entropy", "transitions", "language", "digits", "hexadecimal", "dictionary", "in_path", "assigned", "quoted", "secret_word", "harmless_word", "same_char"]
_SECRET_WORDS = re.compile(r"(?i)token|secret|passw|pwd|api_?-?key|access_?-?key|private_?-?key|credential|auth|bearer")
#: What keys of known services begin with; such a key needs no word before it.
_KEY_PREFIX = re.compile(r"(?:AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|[sr]k_(?:live|test)_|sk-|xox[abprs]-|AIza|npm_|hf_|eyJ)")
#: Whole words, whatever their case; a number may follow those of _NUMBERED.
_HARMLESS_WORDS = ("commit", "sha", "md5", "uuid", "guid", "checksum", "digest", "etag", "rev", "revision", "build", "page", "id", "isbn", "order", "phone", "card", "name", "version", "file", "path", "class", "function")
_NUMBERED = ("sha",)
#: A text without any of these holds none of the words above, and is not searched for them.
_SECRET_PARTS = ("token", "secret", "passw", "pwd", "key", "credential", "auth", "bearer")
_QUOTES = ('"', "'", "`")
_KEY_BEGINNINGS = {"AK", "AS", "gh", "gi", "gl", "sk", "rk", "xo", "AI", "np", "hf", "ey"}
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
_ASSIGNED = re.compile(r"[=:]\s*[\"'`]?\Z")
_PATHLIKE = re.compile(r"(?i)(?:https?://|www\.|[./\\][\w-]+/|\.(?:html?|php|png|jpe?g|js|css)\b)")
#: Classes of characters for transitions: letters whatever their case, digits, other letters, and all else as one.
_CLASSES = 29
_CLASS_OF = bytes(b - 96 if 97 <= b <= 122 else b - 64 if 65 <= b <= 90 else 27 if 48 <= b <= 57 else 28 if b >= 128 else 0 for b in range(256))
_CLASS_TABLE = np.frombuffer(_CLASS_OF, np.uint8)
_KIND_TABLE = np.array([0 if 97 <= b <= 122 else 1 if 65 <= b <= 90 else 2 if 48 <= b <= 57 else 3 for b in range(256)], np.uint8)
_HEX_TABLE = np.array([chr(b) in string.hexdigits for b in range(256)])
_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


@dataclass(frozen=True)
class Language:
    """What a corpus' own text looks like: log2 chances of a character's class after another, and its commonest words."""

    transitions: np.ndarray
    words: frozenset[str]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, key, n): counts of class pairs and of words; words go out whenever there are many different ones."""
    pairs, words = np.zeros(_CLASSES * _CLASSES, np.int64), Counter()

    def table(found: list[tuple[bytes, int]], pair: bool):
        return pa.RecordBatch.from_arrays([pa.array([pair] * len(found), pa.bool_()), pa.array([k for k, _ in found], pa.binary()), pa.array([n for _, n in found], pa.int64())], ["pair", "key", "n"])

    for batch in batches:
        for text in batch.column(0):
            data = (text.as_py() or "").encode("utf-8", "surrogatepass")
            codes = np.frombuffer(b"\0" + data.translate(_CLASS_OF) + b"\0", np.uint8).astype(np.int64)
            pairs += np.bincount(codes[:-1] * _CLASSES + codes[1:], minlength=len(pairs))
            words.update(w for w in data.translate(_LETTERS).split() if SHORTEST <= len(w) <= LONGEST)
            if len(words) > 500_000:
                yield table(list(words.items()), False)
                words.clear()
    yield table(list(words.items()), False)
    yield table([(bytes(divmod(int(k), _CLASSES)), int(pairs[k])) for k in np.flatnonzero(pairs)], True)


def learn_language(docs: DataFrame, text_col: str = "text", max_words: int = MAX_WORDS) -> Language:
    """Counts over every whole text; what comes to the driver are the pairs of classes and max_words words at most. Null
    texts count as empty; without any text all transitions are alike and no word is known."""
    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(_counted, "pair boolean, key binary, n long").groupBy("pair", "key").agg(F.sum("n").alias("n"))
    found = counts.orderBy(F.col("pair").desc(), F.col("n").desc(), "key").limit(max_words + _CLASSES * _CLASSES).collect()
    pairs = np.ones((_CLASSES, _CLASSES))
    for r in found:
        if r.pair:
            pairs[r.key[0], r.key[1]] += r.n
    pairs[0, 0] = 1  # runs of marks and blanks say nothing
    words = [bytes(r.key).decode("utf-8", "replace") for r in found if not r.pair][:max_words]
    return Language(np.log2(pairs / pairs.sum(axis=1, keepdims=True)), frozenset(words))


class Measures:
    """FEATURES of candidates: many at a time with numpy, but for the dictionary's words in them, which are kept for the
    candidates seen last."""

    def __init__(self, language: Language):
        self.chances = language.transitions
        self.words = language.words
        self.beginnings = {w[:SHORTEST] for w in language.words}
        self.covered = lru_cache(100_000)(self._covered)
        self.documented = lru_cache(10_000)(lambda path: bool(re.search(r"(?i)\b(?:test|example|sample|doc)s?\b", path)))

    def _covered(self, found: str) -> float:
        """The share of a candidate's characters that the longest word from each place on covers."""
        low, n, at, covered = found.lower(), len(found), 0, 0
        while at <= n - SHORTEST:
            step = 0
            if low[at : at + SHORTEST] in self.beginnings:
                step = next((k for k in range(min(LONGEST, n - at), SHORTEST - 1, -1) if low[at : at + k] in self.words), 0)
            covered += step
            at += step or 1
        return covered / n

    def rows(self, seen: list[tuple]) -> np.ndarray:
        """FEATURES of each (found, in_path, assigned, quoted, secret_word, harmless_word) of around."""
        found = [x[0] for x in seen]
        n = np.array([len(x) for x in found])
        joined = np.frombuffer(("\0" + "\0".join(found) + "\0").encode(), np.uint8)
        chars, owner = joined[joined != 0], np.repeat(np.arange(len(found), dtype=np.int32), n)
        kinds = _KIND_TABLE[chars]
        changes = (kinds[1:] != kinds[:-1]) & (owner[1:] == owner[:-1])
        classes = _CLASS_TABLE[joined]
        starts = np.cumsum(n + 1) - (n + 1)  # the mark before each candidate
        chance = np.add.reduceat(self.chances[classes[:-1], classes[1:]], starts)
        # each character's number in its candidate: runs of the sorted pairs
        pairs = np.sort(owner * np.int32(128) + chars)
        first = np.flatnonzero(np.diff(pairs, prepend=-1))
        times, of = np.diff(first, append=len(pairs)), pairs[first] >> 7
        count = lambda mask: np.bincount(owner[mask], minlength=len(found))
        out = np.empty((len(found), len(FEATURES)))
        out[:, 0] = np.minimum(n, 256)
        out[:, 1] = np.log2(n) - np.bincount(of, weights=times * np.log2(times), minlength=len(found)) / n
        out[:, 2] = np.bincount(owner[1:][changes], minlength=len(found)) / np.maximum(1, n - 1)
        out[:, 3] = chance / (n + 1)
        out[:, 4] = count(kinds == 2) / n
        out[:, 5] = count(~_HEX_TABLE[chars]) == 0
        out[:, 6] = [self.covered(x) for x in found]
        out[:, 7:12] = [x[1:] for x in seen]
        out[:, 12] = np.maximum.reduceat(times, np.flatnonzero(np.diff(of, prepend=-1))) / n
        return out

    def around(self, text: str, spans: list[tuple[int, int]], path: str) -> Iterator[tuple]:
        """(found, in_path, assigned, quoted, secret_word, harmless_word) of the candidates at spans, from what stands around
        them, and the path (or source) of their text."""
        folded, documented = text.lower(), self.documented(path)
        if len(folded) != len(text):  # a few letters are two in lower case: fold the Latin ones alone, so that places stay
            folded = text.translate(_LOWER)
        secret = _Before([m.span() for m in _SECRET_WORDS.finditer(text)]) if any(w in folded for w in _SECRET_PARTS) else None
        harmless = _Before(_whole_words(folded))
        for a, b in spans:
            found = text[a:b]
            near = text[max(0, a - 12) : a]
            pathlike = documented or (("." in near or "/" in near or "\\" in near or "/" in found) and _PATHLIKE.search(near + found) is not None)
            yield (
                found,
                pathlike,
                ("=" in near or ":" in near) and _ASSIGNED.search(near) is not None,
                near[-1:] in _QUOTES and text[b : b + 1] in _QUOTES,
                (secret is not None and secret.within(a)) or (found[:2] in _KEY_BEGINNINGS and _KEY_PREFIX.match(found) is not None),
                harmless.within(a),
            )


class _Before:
    """Whether one of the spans ends in the _NEIGHBOURS characters before a place; places come in ascending order."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.spans, self.at, self.last = spans, 0, -1

    def within(self, place: int) -> bool:
        while self.at < len(self.spans) and self.spans[self.at][1] <= place:
            self.last = self.spans[self.at][0]
            self.at += 1
        return self.last >= 0 and self.last >= place - _NEIGHBOURS


def _whole_words(folded: str) -> list[tuple[int, int]]:
    """Spans of _HARMLESS_WORDS, in order."""
    out, size = [], len(folded)
    part_of_word = lambda i: 0 <= i < size and (folded[i].isalnum() or folded[i] == "_")
    for word in _HARMLESS_WORDS:
        at = folded.find(word)
        while at >= 0:
            end = at + len(word)
            while word in _NUMBERED and end < size and folded[end].isdecimal():
                end += 1
            if not part_of_word(at - 1) and not part_of_word(end):
                out.append((at, end))
            at = folded.find(word, at + 1)
    return sorted(out)


@dataclass(frozen=True)
class Forest:
    """The trees of a fitted forest, each filled up to one depth: inner nodes in heap order, which go right where feature >
    threshold, and the share of secrets in each leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    share: np.ndarray

    def probability(self, rows: np.ndarray) -> np.ndarray:
        """The mean share of secrets in the leaves that each row of FEATURES comes to."""
        trees, inner = self.feature.shape
        feature, threshold, values = self.feature.ravel(), self.threshold.ravel(), np.ascontiguousarray(rows).ravel()
        row = (np.arange(len(rows), dtype=np.int32) * rows.shape[1])[:, None]
        tree = (np.arange(trees, dtype=np.int32) * inner)[None, :]
        at = np.zeros((len(rows), trees), np.int32)
        for _ in range((inner + 1).bit_length() - 1):
            node = at + tree
            at = 2 * at + 1 + (values[row + feature[node]] > threshold[node])
        return self.share.ravel()[at - inner + np.arange(trees, dtype=np.int32) * (inner + 1)].mean(axis=1)


def train_forest(findings: DataFrame, trees: int = 24, depth: int = 7, seed: int = 11) -> Forest:
    """A forest from rows of FEATURES and label (1: a secret). Rows are put in order first, so that equal findings
    give an equal forest however they were dealt. Its nodes, trees * 2^(depth + 1) at most, come to the driver."""
    spark = findings.sparkSession
    ordered = findings.select(*FEATURES, "label").orderBy(*FEATURES, "label").coalesce(1)
    assembled = VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(ordered)
    model = RandomForestClassifier(featuresCol="_features", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed).fit(assembled)
    path = f"{shared_dir(spark)}/forest-{uuid.uuid4().hex}"
    model.save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").orderBy("treeID", "id").collect()
    by = {(r.treeID, r.id): r for r in nodes}
    inner = (1 << depth) - 1
    feature, threshold, share = np.zeros((trees, inner), np.int32), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for tree in range(trees):
        waiting = [(0, 0)]
        while waiting:
            at, node = waiting.pop()
            r = by[tree, node]
            if at >= inner:
                share[tree, at - inner] = r.impurityStats[1] / sum(r.impurityStats) if len(r.impurityStats) > 1 else 0.0
                continue
            if r.leftChild >= 0:
                feature[tree, at], threshold[tree, at] = r.split.featureIndex, r.split.leftCategoriesOrThreshold[0]
            # a leaf above the last level stands for all leaves below it
            waiting += [(2 * at + 1, r.leftChild if r.leftChild >= 0 else node), (2 * at + 2, r.rightChild if r.leftChild >= 0 else node)]
    return Forest(feature, threshold, share)


def _finding(number: int, words: list[str]) -> tuple[str, str, str, str, int]:
    """(found, before, after, path, label) of a made-up line around words of the corpus: in every other one found is a
    secret."""
    rng = random.Random(f"finding {number}")
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    made = lambda: pick(string.ascii_lowercase, rng.choice([2, 4, 6, 9, 12]))
    word = lambda: rng.choice(words) if words and rng.randrange(5) else made()
    several = lambda n, sep: sep.join(word() for _ in range(n))
    filler = " ".join(w.capitalize() if rng.randrange(5) == 0 else w for w in (word() for _ in range(5)))
    path = f"src{rng.randrange(40)}"
    if number % 2:
        alphabet = rng.choice(["0123456789abcdef", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_uppercase + string.digits, string.ascii_letters + string.digits + "-_"])
        found = pick(string.ascii_letters + string.digits, 1) + pick(alphabet, rng.choice([19, 23, 31, 35, 39, 39, 47, 63]))
        form = rng.randrange(9)
        if form == 0:  # keys that need no word
            prefix, chars, n = rng.choice([("AKIA", string.ascii_uppercase + string.digits, 16), ("ghp_", string.ascii_letters + string.digits, 36), ("sk_live_", string.ascii_letters + string.digits, 24), ("xoxb-", string.digits, 12), ("AIza", string.ascii_letters + string.digits + "_-", 35)])
            return prefix + pick(chars, n), f"{filler} {rng.choice(['', '(', 'key '])}", rng.choice([" ", ".", ")", ","]), path, 1
        if form == 1:  # mixed characters with no word before them
            return pick(string.ascii_letters + string.digits, rng.choice([32, 40, 48, 64])), f"{filler} ", rng.choice([" ", ".", ","]), path, 1
        key = rng.choice(["token", "secret", "api_key", "apikey", "password", "access_key", "auth_token", "client_secret", "private_key", "passwd", "db_password"])
        key = rng.choice([key, key, key.upper(), key.replace("_", "-")])
        if form == 2:  # addresses
            return found, f"{filler} https://www.{word()}.com/{word()}?{rng.choice(['', 'id=7&'])}{key}=", rng.choice([" ", "&", "#"]), path, 1
        if form == 3:  # short ones, and ones that people make up
            found = rng.choice([pick(string.ascii_letters + string.digits, rng.choice([8, 10, 12, 14])), word().capitalize() + pick(string.digits, rng.randint(2, 4)) + pick("_-+", 1) + pick(string.ascii_letters, 2)])
        if form == 4 and rng.randrange(2):
            found += rng.choice(["=", "=="])
        if form == 5:  # headers
            return found, f"{filler} Authorization: {rng.choice(['Bearer ', 'Token ', 'token '])}", rng.choice([" ", "\n", '"']), path, 1
        sign = rng.choice([" = ", "=", "=", ": ", ":", " := ", '": "', "': '"])
        quote = sign[-1] if sign[-1] in "\"'" else rng.choice(['"', "'", "", ""])
        return found, f"{filler} {key}{sign}{'' if sign[-1] == quote else quote}", quote or " ", path, 1
    kind = rng.randrange(10)
    if kind == 0:  # digests and revisions
        return pick("0123456789abcdef", rng.choice([32, 40, 64])), f"{filler} {rng.choice(['commit', 'sha1', 'sha256', 'md5', 'checksum', 'rev'])}{rng.choice([' ', ': ', '='])}", " ", path, 0
    if kind == 1:  # numbers
        return pick(string.digits, rng.randint(8, 24)), f"{filler} {rng.choice(['', 'order ', 'id: '])}", rng.choice([" ", ".", "$"]), path, 0
    if kind == 2:  # identifiers
        name = rng.choice([several(rng.randint(2, 5), rng.choice(["_", "-"])), "".join(word().capitalize() for _ in range(rng.randint(2, 4))), word() + "".join(word().capitalize() for _ in range(2))])
        return (name + rng.choice(["", str(rng.randrange(100))])).ljust(MIN_LENGTH, "x"), f"{filler} {rng.choice(['', 'name = ', 'class '])}", rng.choice([" ", "(", "."]), path, 0
    if kind == 3:  # paths
        return several(4, "/") + f"/{rng.randrange(10000)}", f"{filler} https://www.", " ", path, 0
    if kind == 4:  # placeholders
        return rng.choice([rng.choice("xX0*a1").replace("*", "x") * rng.randint(8, 39), "your_" + rng.choice(["token", "key", "password"]) + "_here", "changeme", "example-" + word()]), f'{filler} {rng.choice(["token", "password", "api_key"])} = "', '"', path, 0
    if kind == 5:  # uuids
        h = pick("0123456789abcdef", 32)
        return f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}", f"{filler} {rng.choice(['id', 'uuid', 'page'])}{rng.choice([': ', '=', ' '])}", " ", path, 0
    if kind == 6:  # dates and versions
        return rng.choice([f"2024-{rng.randint(10, 12)}-{rng.randint(10, 28)}", f"20240{rng.randint(1, 9)}{rng.randint(10, 28)}T{pick(string.digits, 6)}", f"v{rng.randrange(9)}-{rng.randrange(99)}-{word()}"]).ljust(MIN_LENGTH, "0"), f"{filler} {rng.choice(['version ', 'build: ', 'date = ', ''])}", " ", path, 0
    if kind in (7, 8):  # values and plain words that are long
        return (word() + word() + word())[:40].ljust(MIN_LENGTH, "e"), f"{filler} {rng.choice(['', '', 'name = ', 'title: ', 'the token '])}", rng.choice([" ", ".", ","]), path, 0
    return several(3, "") + str(rng.randrange(1000)), f'{filler} name = "', '"', "docs/example", 0  # values that are words


def labelled_findings(spark: SparkSession, language: Language, n: int = N_FINDINGS) -> DataFrame:
    """(number, FEATURES..., label) of the candidates of n made-up lines, as the scan cuts and measures them; half of the
    lines hold a secret. Equal languages give equal findings. Names and fillers are words of the corpus, which take no part
    in the labels."""
    blob = spark.sparkContext.broadcast(language)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measures, words = Measures(blob.value), sorted(w for w in blob.value.words if w.isascii() and w.isalpha())
        for batch in batches:
            made = []
            for i in batch.column(0).to_pylist():
                found, before, after, path, label = _finding(i, words)
                text = before + found + after
                secret = (len(before), len(before) + len(found))
                spans = [m.span() for m in _RUN.finditer(text)]
                made += [(i, seen, float(label and span == secret)) for span, seen in zip(spans, measures.around(text, spans, path), strict=True)]
            columns = measures.rows([x[1] for x in made]).T if made else np.empty((len(FEATURES), 0))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in made], pa.int64()), *(pa.array(c.copy()) for c in columns), pa.array([x[2] for x in made], pa.float64())], ["number", *FEATURES, "label"])

    return spark.range(0, n, 1, 4).mapInArrow(make, "number long, " + ", ".join(f"{f} double" for f in FEATURES) + ", label double")


#: Candidates whose measures are held at a time.
JUDGED_AT_ONCE = 4000
_FOUND = [("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]


def scan_secrets(docs: DataFrame, forest: Forest, language: Language, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """(id, n_candidates, secrets, max_p) for each row of docs: secrets are start, end (code points) and p of candidates
    that at least half of the forest's votes take for a secret, max_p is the largest share of any candidate, or 0.

    One pass, no shuffle: candidates are judged where they are found. Null texts and paths count as empty, null ids stay
    null, repeated rows get equal results, empty tables give no rows, other columns are ignored.
    """
    path = F.col(path_col).cast("string") if path_col in docs.columns else F.lit("")
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), path.alias("path"))
    blob = docs.sparkSession.sparkContext.broadcast((forest, language))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, measures = blob.value[0], Measures(blob.value[1])
        for batch in batches:
            counts, most, secrets = np.zeros(len(batch), np.int64), np.zeros(len(batch)), [[] for _ in range(len(batch))]
            rows, places = [], []

            def judge(counts=counts, most=most, secrets=secrets, rows=rows, places=places) -> None:
                p, owner = trees.probability(measures.rows(rows)), np.array([x[0] for x in places])
                np.add.at(counts, owner, 1)
                np.maximum.at(most, owner, p)
                for k in np.flatnonzero(p >= 0.5).tolist():
                    secrets[places[k][0]].append({"start": places[k][1], "end": places[k][2], "p": float(p[k])})
                rows.clear()
                places.clear()

            for i, (text, path) in enumerate(zip(batch.column(1), batch.column(2), strict=True)):
                text = text.as_py() or ""
                spans = [m.span() for m in _RUN.finditer(text)]
                for span, seen in zip(spans, measures.around(text, spans, path.as_py() or "") if spans else (), strict=True):
                    rows.append(seen)
                    places.append((i, *span))
                    if len(rows) >= JUDGED_AT_ONCE:
                        judge()
            if rows:
                judge()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), pa.array(secrets, pa.list_(pa.struct(_FOUND))), pa.array(most)], ["id", "n_candidates", "secrets", "max_p"])

    kind = own.schema["id"].dataType.simpleString()
    return own.mapInArrow(scan, f"id {kind}, n_candidates long, secrets array<struct<start:int,end:int,p:double>>, max_p double")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document: its candidates, those judged to be secrets (p >= 0.5), their spans, the largest p."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    language = learn_language(docs)
    forest = train_forest(written(labelled_findings(spark, language), "findings"))
    listed = F.array_join(F.transform("secrets", lambda s: F.concat(s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")
    return scan_secrets(docs, forest, language).select(F.col("id").alias("doc_id"), "n_candidates", F.size("secrets").cast("long").alias("n_secrets"), listed.alias("spans"), F.round("max_p", 6).alias("max_p"))


QUERIES = {"op2_secret_scan": op2_secret_scan}
ORACLES = {}
