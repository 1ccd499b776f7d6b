import random
import re
import string

import numpy as np
import pytest

from ledgerlake.llm import secrets
from ledgerlake.llm.secrets import FEATURES, labelled_findings, learn_language, op2_secret_scan, scan_secrets, train_forest

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def language(spark):
    return learn_language(spark.read.parquet(f"{SF}/documents.parquet"))


@pytest.fixture(scope="module")
def forest(spark, language):
    return train_forest(labelled_findings(spark, language))


def test_language_by_brute_force(spark):
    texts = ["Abc abcd, abcd", None, "", "abcd 1x", "abcde"]
    got = learn_language(spark.createDataFrame([(t,) for t in texts], "text string"), max_words=1)
    assert got.words == {"abcd"}
    pairs = np.ones((29, 29))
    for t in texts:
        codes = [0, *(1 + string.ascii_lowercase.index(c) if c in string.ascii_lowercase else 27 if c.isdigit() else 0 for c in (t or "").lower()), 0]
        for a, b in zip(codes, codes[1:], strict=False):
            pairs[a, b] += (a, b) != (0, 0)
    assert np.allclose(got.transitions, np.log2(pairs / pairs.sum(axis=1, keepdims=True)))


def test_held_out_findings(spark, language):
    findings = labelled_findings(spark, language, 3000).cache()
    model = train_forest(findings.where("number % 5 <> 0"))
    held = findings.where("number % 5 = 0").toPandas()
    predicted = model.probability(held[FEATURES].to_numpy()) >= 0.5
    assert (predicted == (held["label"] == 1)).mean() >= 0.95


def test_forest_is_the_fitted_one(spark, language):
    from pyspark.ml.classification import RandomForestClassificationModel
    from pyspark.ml.feature import VectorAssembler

    rows = labelled_findings(spark, language, 300).cache()
    paths = []
    save = RandomForestClassificationModel.save
    with pytest.MonkeyPatch.context() as m:
        m.setattr(RandomForestClassificationModel, "save", lambda self, path: (paths.append(path), save(self, path)))
        model = train_forest(rows)
    judged = RandomForestClassificationModel.load(paths[0]).transform(VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(rows)).toPandas()
    assert np.allclose(model.probability(judged[FEATURES].to_numpy()), [v[1] for v in judged["probability"]])


def test_documents(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = {i: ",".join(f"{m.start(1)}:{m.end(1)}" for m in re.finditer(r'token = "([0-9a-f]{40})"', t)) for i, t in docs.items()}
    rows = op2_secret_scan(spark, SF).collect()
    got = {r.doc_id: r.spans for r in rows}
    assert set(got) == set(want) and len(rows) == len(docs)
    assert all(r.n_candidates == len(list(secrets._RUN.finditer(docs[r.doc_id]))) for r in rows)
    assert all(set(filter(None, want[i].split(","))) <= set(got[i].split(",")) for i in want)
    assert sum(got[i] != want[i] for i in want) <= 0.01 * len(want)


def test_edges(spark, language, forest):
    key = "9f8e7d6c5b4a39281706f5e4d3c2b1a098765432"
    rows = [(1, None, None), (2, "", "p"), (None, f'token = "{key}"', "p"), (4, "1234567890123456 " * 3, None), (5, f'é token = "{key}" token = "{key}"', "p"), (6, "word " * 400_000, "p"), (7, "long_name " * 50_000, "p")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as id", "2 as start", "3 as p", "4 as secrets", "5 as length")
    out = {r.id: [(s.start, s.end) for s in r.secrets] for r in scan_secrets(df, forest, language).collect()}
    assert out == {1: [], 2: [], None: [(9, 49)], 4: [], 5: [(11, 51), (62, 102)], 6: [], 7: []}
    assert scan_secrets(df.limit(0), forest, language).collect() == []
    assert learn_language(df.limit(0)).words == frozenset()


def test_forms_of_keys(spark, language, forest):
    """Recall by form, and no more than a few harmless strings of each form; some forms are not among the findings."""
    rng = random.Random(3)
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    hexa, mixed = lambda: pick("0123456789abcdef", 40), lambda: pick(string.ascii_letters + string.digits, 40)
    name = lambda: "".join(pick(string.ascii_lowercase, 1) + pick("aeiou", 1) + pick("lnrst", 1) for _ in range(rng.randint(3, 5)))
    forms = {
        "token": ('token = "', hexa, '"'), "unquoted": ("api_key=", hexa, " "), "upper": ("API_KEY=", mixed, " "), "url": ("see https://a.org/x?token=", hexa, "&b=1"), "letters": ('password = "', lambda: pick(string.ascii_letters, 24), '"'),
        "aws": ("use ", lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16), " "), "github": ("use ", lambda: "ghp_" + pick(string.ascii_letters + string.digits, 36), " "), "padded": ("secret=", lambda: mixed() + "==", " "), "short": ("password=", lambda: pick(string.ascii_letters + string.digits, 12), " "),
        "yaml": ("  signing_secret: ", lambda: pick(string.ascii_letters + string.digits + "-_", 43).strip("-_").ljust(43, "q"), "\n"), "groups": ('auth_key: "', lambda: "-".join(pick(string.ascii_uppercase + "234567", 8) for _ in range(4)), '"'), "export": ("export STRIPE_TOKEN='", lambda: pick(string.ascii_letters + string.digits, 32), "'"),
    }
    harmless = {
        "digest": ("checksum sha256: ", lambda: pick("0123456789abcdef", 64), " "), "camel": ("call ", lambda: name() + name().capitalize() + name().capitalize(), "("), "snake": ("field ", lambda: f"{name()}_{name()}_{name()}", " "), "word": ("the ", lambda: name() + name(), " "),
        "number": ("order ", lambda: pick(string.digits, 14), " "), "kebab": ("class=", lambda: f"{name()}-{name()}", " "), "path": ("open /usr/", lambda: f"{name()}/{name()}/{name()}", " "),
    }
    rows, want = [], {}
    for form, (before, key, after) in (forms | harmless).items():
        for k in range(50):
            found = key()
            want[f"{form} {k}"] = (len(before) + 5, len(before) + 5 + len(found))
            rows.append((f"{form} {k}", f"line {before}{found}{after}", "p"))
    df = spark.createDataFrame(rows, "doc_id string, text string, source string")
    got = {r.id: {(s.start, s.end) for s in r.secrets} for r in scan_secrets(df, forest, language).collect()}
    caught = {form: sum(want[i] in got[i] for i in want if i.split()[0] == form) for form in forms | harmless}
    assert min(caught[f] for f in forms) >= 43, caught
    assert max(caught[f] for f in harmless) <= 5, caught
