"""op11 to op13 against brute-force versions, on the small table of the other operators."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from halyard.llm import filter_audit, spelling, substring_dedup

from test_llm_operators import ROWS, docs, nothing, same  # noqa: F401  fixtures

# spelling variants ------------------------------------------------------------------------------


def brute_words(rows, thinned=97, least=3):
    counts = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if thinned and h % thinned == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= least}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(words):
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda v: (-words[v], v))
            if words[best] >= 2 * words[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return [(w, form.get(w), root(w), words[w], len(near[w]), words.get(form.get(w))) for w in words]


def spelling_rows():
    rnd = random.Random(3)
    bases = ["colour", "letter", "éàçüñ", "aaaaa", "aaaaaa", "aaaaaaaa", "abcabc", "straßen", "größe×÷", "Receive", "xyzzyx", "mississippi"]
    rows = []
    for i in range(400):
        words = []
        for _ in range(30):
            w = rnd.choice(bases)
            for _ in range(rnd.choice((0, 0, 0, 0, 1, 1, 2, 3))):
                at, c = rnd.randrange(len(w)), rnd.choice("abcéé÷z")
                w = rnd.choice((w[:at] + c + w[at:], w[:at] + w[at + 1 :], w[:at] + c + w[at + 1 :])) or "a"
            words.append(w)
        rows.append((i if i % 9 else None, rnd.choice((" ", "-", "1", "日", "ÿĀ")).join(words)))
    return rows + [(7, None), (8, ""), (9, "x" * 5000 + " colour"), (9, "x" * 5000), (9, "x" * 5000), rows[3], rows[3]]


@pytest.mark.parametrize("owners, scanned", [(16_384, 16_384), (5, 7), (9, 1000)])
def test_spelling_variants_equal_brute_force(spark, owners, scanned):
    rows = spelling_rows()
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n long, word string").repartition(6)
    found = [tuple(r) for r in spelling.variants(table, owners=owners, scanned=scanned).collect()]
    wanted = brute_variants(brute_words(rows))
    assert any(f and r != f for _, f, r, *_ in wanted) and sum(f is not None for _, f, *_ in wanted) > 50
    same(found, wanted)


def test_spelling_of_the_common_table_and_of_nothing(docs, nothing):  # noqa: F811
    rows = [(r[0], r[1]) for r in ROWS]
    same([tuple(r) for r in spelling.variants(docs).collect()], brute_variants(brute_words(rows)))
    assert spelling.variants(nothing).collect() == []


def test_checksums_are_crc32():
    rnd = random.Random(1)
    texts = ["é" * k + "".join(rnd.choices("abcxyz", k=k * 7 % 90)) for k in range(60)] + ["q" * 3000]
    held: dict = {}
    spelling.count_block(pa.array(texts), pa.array(range(len(texts))), held, 3)
    wanted: dict = {}
    for w, n in brute_words(list(enumerate(texts)), thinned=3, least=1).items():
        wanted[w.encode()] = n
    assert held == wanted


# filter interaction audit -----------------------------------------------------------------------


def brute_audit(rows, labels):
    least = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            least[text or ""] = min(least.get(text or "", doc_id), doc_id)
    good, toxic = ({d for d, *v in labels if v[k] == 1 and d is not None} for k in (0, 1))
    parts = collections.defaultdict(list)
    for doc_id, text, source in rows:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search("[#$%&*|]", text)), "E": doc_id is not None and least[text] < doc_id,
        }
        parts[source or ""].append(({c for c in "ABCDE" if fails[c]}, doc_id in good, doc_id in toxic))
    out = []
    for part, held in parts.items():
        shapley, lines = collections.Counter(), []
        for order in itertools.permutations("ABCDE"):
            left = held
            for step, c in enumerate(order, 1):
                gone = [x for x in left if c in x[0]]
                left = [x for x in left if c not in x[0]]
                fails = sum(c in x[0] for x in held)
                shapley[c] += len(gone)
                lines.append((c, part, "".join(order), step, len(left), len(gone), fails - len(gone), sum(x[0] == {c} for x in held), sum(x[1] for x in gone), sum(x[2] for x in gone)))
        out += [(*x, shapley[c]) for c, *x in lines]
    return out


def audit_rows():
    rows = [(r[0], r[1], r[3]) for r in ROWS]
    rows += [(100 + i, ROWS[10][1], "hot") for i in range(120)] + [(None, ROWS[10][1], "hot")] * 5 + [(300, "same row", "r")] * 40 + [(None, None, None)] * 3
    return rows + [(500 + i, f"{'Ab # ' * (i % 3)}word {i % 7}", f"s{i % 4}") for i in range(60)]


LABELS = [(i, i % 2, (i // 2) % 2) for i in range(0, 560, 3)] + [(3, 1, 1), (None, 1, 1), (6, None, None)]


@pytest.mark.parametrize("fingerprint", [F.xxhash64, lambda text: F.lit(1), lambda text: F.pmod(F.crc32(text), F.lit(3))])
def test_audit_equals_brute_force_whatever_the_fingerprint(spark, fingerprint):
    rows = audit_rows()
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, part string, mask int").repartition(7)
    labels = spark.createDataFrame([(*r, "x") for r in LABELS], "doc_id long, quality int, toxic int, part string")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = filter_audit.audit(table, labels, fingerprint=fingerprint).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    same([tuple(r) for r in found], brute_audit(rows, LABELS))


def test_audit_of_nothing(spark, nothing):  # noqa: F811
    assert filter_audit.audit(nothing, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []


def test_long_text_is_compared_whole(spark):
    text = "w1 " * 300_000
    table = spark.createDataFrame([(1, text + "a", "s"), (2, text + "b", "s"), (3, text + "a", "s")], "doc_id long, text string, source string")
    rows = {r.doc_id: r["mask"] for r in filter_audit.audited_rows(table).collect()}
    assert [rows[k] & 16 for k in (1, 2, 3)] == [0, 0, 16]
    assert hashlib.sha256(text.encode()).hexdigest() and rows[1] & 2


# substring dedup --------------------------------------------------------------------------------


def brute_repeats(rows, window=20):
    first, texts = {}, [(d, re.findall("[^\x20\x09-\x0d]+", t or "")) for d, t in rows]
    order = lambda d, p: (d is None, d or 0, p)
    for d, words in texts:
        for p in range(len(words) - window + 1):
            key = tuple(words[p : p + window])
            first[key] = min(first.get(key, order(d, p)), order(d, p))
    out = []
    for d, words in texts:
        gone = set()
        for p in range(len(words) - window + 1):
            if first[tuple(words[p : p + window])] < order(d, p):
                gone.update(range(p, p + window))
        out.append((d, len(words), len(gone), hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in gone).encode()).hexdigest()))
    return out


def passage_rows():
    rnd = random.Random(11)
    passages = [[f"{rnd.choice('abcdéß')}{rnd.randrange(400)}" for _ in range(rnd.choice((19, 20, 21, 25, 60)))] for _ in range(12)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(rnd.randrange(5)):
            words += rnd.choice(passages) if rnd.random() < 0.7 else [rnd.choice("xyz") for _ in range(rnd.randrange(40))]
            words += [f"own{i}{rnd.randrange(9)}" for _ in range(rnd.randrange(8))]
        rows.append((rnd.randrange(90) if i % 10 else None, "".join(w + rnd.choice((" ", "\n", " \t ")) for w in words)))
    rows += [(500, " ".join(["same"] * 100)), (501, None), (502, ""), (503, " \t"), (3, rows[0][1]), (400, " ".join(passages[4] * 30)), (-5, " ".join(passages[4]))]
    return rows + [rows[1]] * 9 + [(None, rows[2][1])] * 9


@pytest.mark.parametrize("blocks, period, cover", [(None, 13, (0, 1, 3, 9)), (40, 13, (0, 1, 3, 9)), (7, 7, (0, 1, 3)), (5, 20, tuple(range(20)))])
def test_repeats_equal_brute_force(spark, blocks, period, cover):
    rows = passage_rows()
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, block int, kept string").repartition(6)
    found = substring_dedup.remove_repeats(table, blocks=blocks, buckets=blocks and 5, period=period, cover=cover)
    wanted = brute_repeats(rows)
    assert sum(n for *_, n, _ in wanted) > 500
    same([tuple(r) for r in substring_dedup.report(found).collect()], wanted)
    for r in found.collect():
        assert sum(b - a for a, b in r.removed) == r.n_removed


def test_repeats_of_the_common_table_and_of_nothing(docs, nothing):  # noqa: F811
    same([tuple(r) for r in substring_dedup.report(substring_dedup.remove_repeats(docs)).collect()], brute_repeats([(r[0], r[1]) for r in ROWS]))
    assert substring_dedup.remove_repeats(nothing).collect() == []


def test_windows_that_share_their_first_hash_are_told_by_the_second():
    import numpy as np

    known = np.zeros(4, substring_dedup._RECORD)
    known["a"], known["b"] = [1, 5, 5, 5], [9, 2, 4, 7]
    second = np.array([9, 7, 3, 2, 8, 4], np.uint32)
    here, at = substring_dedup._found(known, np.array([1, 5, 5, 5, 6, 5], np.uint64), lambda k: second[k])
    assert here.tolist() == [0, 1, 3, 5] and at.tolist() == [0, 3, 1, 2]


def test_packed_values_come_back():
    import numpy as np

    records = np.zeros(5, substring_dedup._RECORD)
    records["a"], records["id"], records["flags"] = [1 << 63, 5, 0, 7, 9], [-1, -(1 << 63), 3, 0, 8], [0, 1, 2, 3, 0]
    for values in (records, records[:0], records["a"].copy()):
        assert (substring_dedup.unpack(substring_dedup.pack(values), values.dtype) == values).all()


def test_cover_must_be_a_difference_cover(docs):  # noqa: F811
    with pytest.raises(ValueError):
        substring_dedup.remove_repeats(docs, cover=(0, 1, 2, 3))


def test_texts_are_dealt_once(docs):  # noqa: F811
    found = substring_dedup.remove_repeats(docs)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    plan = plan[: plan.index("Initial Plan")] if "Initial Plan" in plan else plan
    assert plan.count("ReusedExchange") >= 2
