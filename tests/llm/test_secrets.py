import hashlib
import itertools
import random
import re
import time

from pyspark.sql import functions as F

from plumbline.llm import queries, secrets

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def slow_base(text):
    text = text or ""
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(kind, start, end) for start, _, end, kind in sorted(found)]


def test_query_against_python(spark, sf):
    got = {r.doc_id: r for r in queries.op4_secret_scan(spark, sf).collect()}
    for row in spark.read.parquet(f"{sf}/documents.parquet").collect():
        want = slow_base(row.text)
        text = ",".join(f"{k}:{a}:{z}" for k, a, z in want)
        r = got[row.doc_id]
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == kind for k, _, _ in want) for kind in ("assign", "access", "hex")]
        assert [s for s in r.spans.split(",") if s and not s.startswith("model")] == [s for s in text.split(",") if s]


def test_base_spans_of_awkward_texts(make_docs, edge_docs, empty_docs):
    texts = ["token=abc password: 'hunter22'", "password = token: \"abcdefgh\"", "\U0001f600 API_KEY=\"ab.cd-ef\" x apikey:zzzzzz", "AKIAAKIA" + "A" * 14,
             "f" * 24 + "g" + "0" * 23, "secret\n=abcdef", "Token='" + "0123456789abcdef" * 2 + "'", "AKIA" + "B" * 15, "tokentoken=abcdef", ""]
    docs = make_docs(list(enumerate(texts)))
    for df in (docs, edge_docs, empty_docs):
        for r in secrets.Model([0.0] * (len(secrets.ALPHABET) + 1) ** 2).find(df).collect():
            assert [(s.kind, s.start, s.end) for s in r.secrets] == slow_base(r.text)


def test_model_finds_random_strings_and_spares_words(make_docs):
    rng = random.Random(5)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    draw = lambda n: "".join(rng.choice(letters) for _ in range(n))
    plain = ["configuration", "international", "responsibility", "get_user_name", "window_manager", "understanding", "characteristic"]
    rows = [(i, " ".join(rng.choices(plain, k=30)) + f" token={draw(32)}") for i in range(200)]
    hidden = draw(36)
    rows += [(900, f"see {hidden} there"), (901, "get_user_name_of_window_manager internationalresponsibility")]
    docs = make_docs(rows)
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.secrets] for r in secrets.Model.fit(docs).find(docs).filter(F.col("doc_id") >= 900).collect()}
    assert found == {900: [("model", 4, 4 + len(hidden))], 901: []}


def slow_spans(model, text):
    """Base spans and, of the runs that overlap none, those whose ratio is large enough: all spans against all runs."""
    base, text = slow_base(text), text or ""
    out = [(start, [*(n for n, _, _ in secrets.PATTERNS)].index(kind), end, kind) for kind, start, end in base]
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{%d,}" % secrets.RUN, text):
        codes = [0, *(secrets.ALPHABET.index(c) + 1 for c in m[0])]
        ratio = sum(round(model.ratios[a * (len(secrets.ALPHABET) + 1) + b - 1], 6) for a, b in zip(codes, codes[1:], strict=False))
        if ratio >= secrets.LEAST and not any(start < m.end() and m.start() < end for _, start, end in base):
            out.append((m.start(), len(secrets.PATTERNS), m.end(), "model"))
    return [(kind, start, end) for start, _, end, kind in sorted(out)]


def crowded_text(rng, n):
    """Runs and base spans side by side, within each other and overlapping."""
    letters = secrets.ALPHABET
    draw = lambda k, of=letters: "".join(rng.choice(of) for _ in range(k))
    kinds = [lambda: f"token={draw(rng.randint(3, 30))}", lambda: draw(rng.randint(15, 40)), lambda: draw(30, "0123456789abcdef"), lambda: draw(22, "0123456789abcdef") + draw(9),
             lambda: "AKIA" + draw(17, "ABCDEFGH0123"), lambda: draw(25) + ".x", lambda: "\U0001f600 secret: '" + draw(24, "abcdef0123456789") + draw(5) + "'", lambda: "word"]
    return "".join(rng.choice(kinds)() + rng.choice([" ", "\n", ".", "", " "]) for _ in range(n))


def test_spans_against_all_pairs(make_docs, spark, sf):
    rng = random.Random(17)
    ratios = [rng.uniform(-0.6, 1.4) for _ in range((len(secrets.ALPHABET) + 1) ** 2)]
    docs = make_docs([(i, crowded_text(rng, n)) for i, n in enumerate([0, 1, 2, 3, 30, 63, 64, 65, 66, 130, 700, 3000])])
    fitted = secrets.Model.fit(spark.read.parquet(f"{sf}/documents.parquet"))
    seen = set()
    for model in (secrets.Model(ratios), fitted):
        for r in model.find(docs).collect():
            want = slow_spans(model, r.text)
            assert [(s.kind, s.start, s.end) for s in r.secrets] == want
            seen |= {kind for kind, _, _ in want}
    assert seen == {"assign", "access", "hex", "model"}


def test_running_totals(spark):
    rng = random.Random(2)
    rows = [([rng.randint(-9, 9) for _ in range(n)],) for n in (0, 1, 63, 64, 65, 128, 129, 5000)]
    got = spark.createDataFrame(rows, "v array<int>").select("v", secrets.running(F.col("v")).alias("sums"), secrets.running(F.col("v"), F.greatest).alias("most")).collect()
    for r in got:
        assert r.sums == list(itertools.accumulate(r.v)) and r.most == list(itertools.accumulate(r.v, max))


def test_time_grows_with_the_number_of_spans(make_docs):
    rng = random.Random(8)
    draw = lambda n: "".join(rng.choices(secrets.ALPHABET[:62], k=n))
    model = secrets.Model([1.0] * (len(secrets.ALPHABET) + 1) ** 2)
    times = []
    for n in (10, 2000, 8000):  # pairs of spans; the first run compiles
        docs = make_docs([(1, " ".join(f"token={draw(20)} {draw(24)}" for _ in range(n)))])
        start = time.monotonic()
        (r,) = model.find(docs).collect()
        times.append(time.monotonic() - start)
        assert len(r.secrets) == 2 * n
    assert times[2] < times[1] + 4
