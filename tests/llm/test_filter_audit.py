"""The filter audit against a walk through every order, one document after the other."""

import itertools
import random
import re

from cairn.llm import filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, part string, mask int, n long, label int, task long, quality int"


def brute(rows, labels):
    good = {i for i, quality, _ in labels if quality == 1 and i is not None}
    bad = {i for i, _, toxic in labels if toxic == 1 and i is not None}
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    seen = []
    for i, text, source in rows:
        text, words = text or "", WORD.findall(text or "")
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": i is not None and i > least[text]}
        seen.append((source or "", i, {f for f in fails if fails[f]}))
    out = {}
    for part in {s[0] for s in seen}:
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            here = [(i, fails) for p, i, fails in seen if p == part]
            left = here
            for step, f in enumerate(order, 1):
                gone = [(i, fails) for i, fails in left if f in fails]
                left = [(i, fails) for i, fails in left if f not in fails]
                shapley[f] += len(gone)
                failing = sum(f in fails for _, fails in here)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), sum(fails == {f} for _, fails in here), sum(i in good for i, _ in gone), sum(i in bad for i, _ in gone)]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(shapley[order[step - 1]])
    return out


def got(df):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in df.collect()}


def run(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, s, "x", 1, 2, 3, 4, 0) for i, t, s in rows], DOCS)
    return filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_audit_equals_walks(spark):
    rng = random.Random(5)
    texts = [None, "", " \t", "A B C", "x " * 60, " ".join(map(str, range(70))), " ".join(f"Üé{i}" for i in range(55)) + "#", "W" * 30 + " " + " ".join(map(str, range(60))), "\x1c\x85 a\xa0b c", "long " * 30000, "|"]
    rows = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice([None, "", "a", "b", "a b"])) for _ in range(150)]
    rows += [(7, "same", "a")] * 3 + [(8, "same", "c"), (-1, "x " * 60, "z")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in [*range(45), 3, 3, 8, None]]
    assert got(run(spark, rows, labels)) == brute(rows, labels)


def test_audit_hot_group_and_no_rows(spark):
    rows = [(i, "copy", "a") for i in range(3000)] + [(9000 + i, f"text {i}", f"s{i % 700}") for i in range(1400)]
    out = got(run(spark, rows, [(2999, 1, 1)]))
    assert len(out) == 701 * 600
    assert out["a", "EABCD", 1][:2] == [1, 2999] and out["a", "EABCD", 1][4:6] == [1, 1]
    assert out["a", "ABCDE", 5][2] == 2999 and out["s3", "ABCDE", 1][1] == 2
    assert run(spark, [], []).count() == 0


def test_table_of_first_failures():
    table = filter_audit.first_failures()
    assert table.shape == (32, 120) and (table[0] == 5).all()
    for column, order in enumerate(itertools.permutations(range(5))):
        for mask in range(1, 32):
            assert table[mask, column] == next(k for k, f in enumerate(order) if mask >> f & 1)
