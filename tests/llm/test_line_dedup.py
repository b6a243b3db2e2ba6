import random
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import line_dedup, line_tokens, queries


def slow(rows):
    """Places of removed lines by comparing each line with all earlier ones. rows: (doc_id, text)."""
    docs = sorted({(r[0], r[1]) for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
    assert len({d for d, _ in docs}) == len(docs), "this order needs distinct ids"
    earlier, out = {}, {}
    for doc, text in docs:
        for k, line in enumerate("".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split(b"\n")):
            own = frozenset(line.split())
            if not own:
                continue
            if own in earlier or any(10 * len(own & x) >= 8 * len(own | x) for x in earlier):
                out.setdefault((doc, text), set()).add(k)
            earlier[own] = None
    return {r: "\n".join(line for k, line in enumerate(r[1].split("\n")) if k not in out.get(r, ())) for r in docs}


def check(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = slow(rows)
    got = line_dedup.drop_repeated_lines(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.text == (None if r.row.text is None else want[r.row.doc_id, r.row.text])


def made(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(80)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 30))] for _ in range(12)]
    rows = []
    for d in range(n):
        lines = []
        for _ in range(rng.randint(0, 6)):
            words = list(rng.choice(base)) if rng.random() < 0.7 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 12))]
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            lines.append("  ".join(words).upper() if rng.random() < 0.1 else " ".join(words))
        rows.append((d, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("lags", [1, 8])
def test_random_lines_against_all_pairs(make_docs, monkeypatch, lags):
    monkeypatch.setattr(line_dedup, "LAGS", lags)
    check(make_docs(made(lags)))


def test_texts_beyond_one_stretch(make_docs, monkeypatch):
    monkeypatch.setattr(line_tokens, "_STRETCH", 50)
    parts = [lines.text.tolist() for lines in line_tokens.lines_of([b"a b c " * 10, b"d\ne f", b"", b"g " * 60, b"h"], line_tokens.levels_of(np.ones(1 << line_tokens.COUNT_BITS)))]
    assert parts == [[0, 1, 1, 3], [4]]


def test_one_text_of_more_lines_than_are_sorted_at_once():
    n = (1 << line_tokens._LINE_BITS) + 5
    levels = line_tokens.levels_of(np.ones(1 << line_tokens.COUNT_BITS))
    text = "\n".join(f"w{k} w{k % 7} w{k}" for k in range(n)).encode()
    (lines,) = line_tokens.lines_of([text], levels)
    assert lines.line.tolist() == list(range(n)) and lines.size.tolist() == [len({k, k % 7}) for k in range(n)]
    for k in (0, 8, n - 6, n - 5, n - 1):
        (alone,) = line_tokens.lines_of([text.split(b"\n")[k]], levels)
        own = slice(lines.start[k], lines.start[k] + lines.size[k])
        assert lines.order[own].tolist() == alone.order.tolist() and lines.hashes[own].tolist() == alone.hashes.tolist()


def test_edge_cases(make_docs, empty_docs):
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    rows = [(1, "one two three four five\nb"), (1, "one two three four five\nb"), (2, None), (3, ""), (None, "a b c\nd e"), (None, None),
            (4, " \n\t \n"), (5, long), (6, "b\nfive four three two one\nZoë\n\nzoë\nZOë"), (7, long + " end"), (8, "\r\nb")]
    check(make_docs(rows, "doc dh key line gone text_ first x y word own_id whole row"))
    assert line_dedup.drop_repeated_lines(empty_docs).count() == 0


def test_query_against_all_pairs(spark, sf):
    want = slow([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
    got = {r.doc_id: r.text for r in queries.op2_line_dedup(spark, sf).collect()}
    assert got == {doc: text for (doc, _), text in want.items()}


def test_only_the_result_stays_in_the_shared_folder(spark, make_docs):
    import os

    from plumbline.llm.common import shared_folder

    before = set(os.listdir(shared_folder(spark)))
    found = line_dedup.drop_repeated_lines(make_docs([(1, "a b c d e f\nx"), (2, "y\na b c d e f")]))
    assert len(set(os.listdir(shared_folder(spark))) - before) == 1
    assert sorted(r.text for r in found.collect()) == ["a b c d e f\nx", "y"]


def entries_of(sets, seed):
    """The list of all prefix words of the sets, as a task of candidates() meets it; several sets a document."""
    rng = random.Random(seed)
    parity = [[0, 0] for _ in sets]
    for k, words in enumerate(sets):
        for w in words:
            bit = hash((w, seed)) % 128
            parity[k][bit // 64] ^= 1 << (bit % 64)
    rows = []
    for k, words in enumerate(sets):
        order = sorted(words, key=lambda w: -w)  # variable words are the higher numbers and come first
        n = len(order)
        for pos, w in enumerate(order[: n + 1 + (-4 * n) // 5]):
            rows.append((w, k // 3, *parity[k], n, pos, True))
    rng.shuffle(rows)
    rows.sort(key=lambda r: r[:2])
    kinds = [np.int64, np.int64, np.uint64, np.uint64, np.int64, np.int64, bool]
    columns = [np.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)]
    return line_dedup._List([c.view(np.int64) if c.dtype == np.uint64 else c for c in columns]), [tuple(p) for p in parity]


@pytest.mark.parametrize("many", [0, 1 << 30])
@pytest.mark.parametrize("seed", range(6))
def test_long_lists_against_all_pairs(monkeypatch, seed, many):
    """Lists split by size and leading words, compared by parts of the parity bits (many = 0) or in blocks."""
    monkeypatch.setattr(line_dedup, "LONG", 3)
    monkeypatch.setattr(line_dedup, "MANY", many)
    monkeypatch.setattr(line_dedup, "_MATRIX", 50)
    rng = random.Random(seed)
    templates = [rng.sample(range(60 * t, 60 * t + 50), rng.randint(4, 45)) for t in range(4)]
    sets = []
    for _ in range(150):
        words = list(rng.choice(templates))
        for _ in range(rng.randint(0, max(1, len(words) // 7))):
            words[rng.randrange(len(words))] = rng.randrange(300)
        sets.append(frozenset(words[: rng.randint(max(4, len(words) - 4), len(words))]))
    sets = [x for x in dict.fromkeys(sets) if len(x) >= line_dedup.LEAST]
    found, parity = entries_of(sets, seed)
    together = {frozenset((parity[i], parity[j])) for i, x in enumerate(sets) for j, y in enumerate(sets[:i])
                if 10 * len(x & y) >= 8 * len(x | y) and parity[i] != parity[j]}
    assert len(together) > 50
    odd = list(zip(found.odd1.view(np.uint64).tolist(), found.odd2.view(np.uint64).tolist(), strict=True))
    got = {frozenset((odd[x], odd[y])) for xs, ys, _ in found.pairs(True) for x, y in zip(xs.tolist(), ys.tolist(), strict=True)}
    assert together <= got
    # The first round names a partner for every set with an earlier one.
    least = {p: min(k // 3 for k, q in enumerate(parity) if q == p) for p in parity}
    late = {p for pair in together for p in pair if any(least[q] < least[p] for q in pair)}
    best = {odd[y] for _, ys, _ in found.pairs(False) for y in ys.tolist()}
    assert late <= best


def test_template_lines_form_no_pairs():
    """Lines of one template share words that lead in none of them: nothing is compared."""
    sets = [frozenset((10_000 + k, 9_000 - k % 7, 3, 2, 1)) for k in range(30_000)]
    found, _ = entries_of(sets, 0)
    assert sum(len(x) for x, _, _ in found.pairs(True)) == 0


def test_long_lists_of_many_batches(make_docs):
    """A word of thousands of lines, some of which match, and lines that begin with frequent words."""
    rng = random.Random(5)
    rows = [(k, f"user{k} posted this on monday\nreport total sum " + " ".join(str(rng.randrange(40)) for _ in range(9))) for k in range(700)]
    check(make_docs(rows))


@pytest.mark.parametrize("seed", range(4))
def test_the_first_round_names_all_partners_or_says_that_there_are_more(monkeypatch, seed):
    """Only entries of crowded lists are met again if their partners fail."""
    monkeypatch.setattr(line_dedup, "_MATRIX", 70)
    rng = random.Random(seed)
    templates = [rng.sample(range(60 * t, 60 * t + 50), rng.randint(20, 45)) for t in range(30)]
    sets = []
    for _ in range(200):
        words = list(rng.choice(templates))
        for _ in range(rng.randint(0, len(words) // 6)):
            words[rng.randrange(len(words))] = rng.randrange(2000)
        sets.append(frozenset(words))
    sets = list(dict.fromkeys(sets))
    found, _ = entries_of(sets, seed)
    odd = list(zip(found.odd1.tolist(), found.odd2.tolist(), strict=True))
    pairs = lambda every: {(odd[x], y) for xs, ys, _ in found.pairs(every) for x, y in zip(xs.tolist(), ys.tolist(), strict=True)}
    named, full = pairs(False), pairs(True)
    assert named <= full and max(Counter(y for _, y in named).values()) == line_dedup.KEPT
    assert {(x, y) for x, y in full if not found.more[y]} <= named
    partners = Counter(y for _, y in full)
    assert sum(1 < partners[y] <= line_dedup.KEPT and not found.more[y] for y in partners) > 30
    assert any(found.more) and not any(found.more[y] for y in range(len(odd)) if not partners[y])


def test_sets_whose_best_partner_fails_are_not_read_again(make_docs, monkeypatch):
    """Lines that share 53 of 60 words just fail; some of their parities pass. All partners are verified in the first round."""
    own = [[f"v{k}x{j}" for j in range(7)] for k in range(5)]
    near = [" ".join([f"w{j}" for j in range(53)] + words) for words in own]
    often = "\n".join(word for words in own for word in words for _ in range(30))  # the shared words are rarer
    rows = [*enumerate(near), (9, near[1].replace("v1x1", "other")), (10, often)]
    rounds = []
    monkeypatch.setattr(line_dedup, "candidates", lambda lines, failed=None, was=line_dedup.candidates: rounds.append(failed) or was(lines, failed))
    check(make_docs(rows))
    assert rounds == [None]


def test_words_in_numpy_against_split():
    """Words, their lines and equal hashes for equal words alone, without a Python object for each word."""
    rng = random.Random(3)
    alphabet = [bytes([b]) for b in b"aBc \t\n\r\x0b\x0c\x00\x0e\x1c"] + ["é".encode(), b"x" * 20, b"y" * 70]
    for _ in range(200):
        texts = [b"".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 5, 60, 400]))) for _ in range(rng.randint(1, 9))]
        words = line_tokens.words_of([*texts, b"abcdef", b"abcdef\x00\x0e", b"abcdef\x00"])
        lines = [(k, n, line.lower().split()) for k, text in enumerate([*texts, b"abcdef", b"abcdef\x00\x0e", b"abcdef\x00"]) for n, line in enumerate(text.split(b"\n"))]
        assert list(zip(words.text.tolist(), words.line.tolist(), words.sizes.tolist())) == [(k, n, len(own)) for k, n, own in lines if own]
        flat = [w for *_, own in lines for w in own]
        assert len(flat) == len(words.hashes) and len(set(zip(flat, words.hashes.tolist()))) == len(set(flat)) == len(set(words.hashes.tolist()))


def test_entries_are_dealt_in_few_rows():
    rng = np.random.default_rng(4)
    entries = rng.integers(-(1 << 63), 1 << 63, (5, 20_000))
    entries[0, :5_000] = 77  # a word in many sets
    batch = line_dedup._dealt(entries)
    assert batch.num_rows <= line_dedup.PARTS + 5
    got = []
    for part, held in zip(batch.column("part").to_pylist(), batch.column("entries").to_pylist(), strict=True):
        own = np.frombuffer(held, np.int64).reshape(5, -1)
        assert own.shape[1] <= line_dedup.BLOCK and set((own[0] & (line_dedup.PARTS - 1)).tolist()) == {part}
        got += map(tuple, own.T.tolist())
    assert sorted(got) == sorted(map(tuple, entries.T.tolist()))
