"""Personal data: patterns against the plain regular expressions, disclosure against counts in dictionaries."""

import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict

from cairn.llm import sanitise

PLAIN = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
COLUMNS = "doc_id long, text string, key string, near string, term string, base string, spans string"


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            sound = [True, kind == 1 and all(int(p) <= 255 for p in m.group().split(".")), 12 <= len(digits) <= 19 and luhn(digits), 9 <= len(digits) <= 15][kind]
            if sound:
                out.append((m.start(), kind, m.end(), [m.group().lower(), m.group(), digits, digits][kind]))
    return sorted(out)


def brute(rows):
    """The revealing terms with their forms, and the spans of each row, by dictionaries."""
    texts = [t or "" for _, t in rows]
    n_entity, n_term, pair, contexts = Counter(), Counter(), Counter(), defaultdict(set)
    with_form = lambda terms: set(terms) | {f"{t[:4]}*" for t in terms if len(t) > 4}
    places = []
    for text in texts:
        spans, blank = plain_spans(text), list(text)
        for a, _, b, _ in spans:
            blank[a:b] = " " * (b - a)
        found = [(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"[^\W_]{3,}", "".join(blank))]
        places.append((spans, found))
        n_term.update(with_form({t for *_, t in found}))
        near = defaultdict(set)
        for a, kind, _, value in spans:
            around = [t for s, _, t in found if s < a][-8:] + [t for s, _, t in found if s >= a][:8]
            for t in with_form(around):
                near[kind, value].add(t)
                contexts[(kind, value), t].add(tuple(around))
        for c in {(k, v) for _, k, _, v in spans}:
            n_entity[c] += 1
            pair.update((c, t) for t in near[c])
    told = {(c, t): math.log2(len(texts) * n / (n_entity[c] * n_term[t])) / math.log2(len(texts) / n_entity[c]) for (c, t), n in pair.items() if n_entity[c] < len(texts)}
    revealing = {}
    for t in {t for c, t in told if not t.endswith("*") and len(contexts[c, t]) >= 3 and told[c, t] >= 0.8}:
        entities = [c for c, x in told if x == t and len(contexts[c, t]) >= 3 and told[c, t] >= 0.8]
        form = f"{t[:4]}*" if len(t) > 4 else None
        revealing[t] = form if form and max(told[c, form] for c in entities) < 0.8 else None
    name = ["email", "ip", "card", "phone", "term"]
    lines = []
    for spans, found in places:
        every = sorted([s[:3] for s in spans] + [(a, 4, b) for a, b, t in found if t in revealing])
        lines.append(",".join(f"{name[k]}:{a}:{b}" for a, k, b in every))
    return revealing, lines, [spans for spans, _ in places]


ODD = [None, "", "a@b.c", "x a@b.co_y@d.com z", "a@b.c@d.e.f", "a@.b c@d", "..@x-.y.-", "1.2.3.4.5.6.7.8", "256.1.1.1 001.002.003.255", "1.1.1.1.", "4111 1111-1111 1111", "4111111111111112", "+1 (234) 555-6789", "+12345678", "+1 ((((( 2", "++49.30.1234567 -", "é@ü.de ñ+49 301 234 5678", "4111111111111111+1234567890"]


def sample(rng):
    """Rows in which a surname goes with an address in many surroundings, and a first name with many addresses."""
    words = [f"w{i}ord" for i in range(60)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, say(30)) for i in range(120)]
    rows += [(200 + i, f"{say(9)} Dr. Quendolin Xylophanes Zabriskie <q.zab@example.org> {say(7)}") for i in range(6)]
    rows += [(300 + i, f"{say(9)} Anna anna{i % 7}@example.org {say(3)} +1 (234) 555-678{i % 5} Zabri") for i in range(20)]
    rows += [(400 + i, f"once upon mail Obscuritan obs@example.org {words[3]}") for i in range(9)]  # one passage, copied
    rows += [(500 + i, f"{say(4)} quendolina quendolinb quendolinc quendolind{i} {say(4)}") for i in range(40)]
    rows += [(600, f"{say(3)} later the ZABRISKIE file and Zabriskie_x {say(2)}"), (None, "Zabriskie"), (600, "Zabriskie again"), (600, "Zabriskie again"), (7, "tag 10.0.0.1 " * 3)]
    return rows + list(enumerate(ODD, 700))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", "n", "t", "b", "s") for i, t in rows], COLUMNS)


def test_patterns_equal_plain_ones():
    rng = random.Random(2)
    texts = [t or "" for t in ODD] + ["".join(rng.choice("01a.@+- (_%é9") for _ in range(rng.randrange(1, 60))) for _ in range(6000)]
    for text in texts:
        assert sanitise.base_spans(text) == plain_spans(text), text


def test_patterns_are_linear():
    for text in ("a" * 400_000, "a@" * 200_000, "1" * 400_000, "1." * 200_000, "+1 " * 130_000, "+1" + " " * 400_000, "a.b@c" * 80_000, "1-" * 200_000):
        began = time.perf_counter()
        sanitise.base_spans(text)
        assert time.perf_counter() - began < 5


def test_disclosure_equals_counts(spark):
    rows = sample(random.Random(4))
    revealing, lines, base = brute(rows)
    assert "zabriskie" in revealing and "anna" not in revealing and "obscuritan" not in revealing
    assert revealing["quendolin"] == "quen*" and revealing["zabriskie"] == "zabr*" and revealing["xylophanes"] is None
    got = sanitise.inspect(frame(spark, rows)).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0, r.spans) for r in got)) == sorted((i is None, i or 0, x) for (i, _), x in zip(rows, lines, strict=True))
    by_id = {r.doc_id: r for r in got}
    for (i, _), spans in zip(rows, base, strict=True):
        if i is not None and i >= 200 and i != 600:
            digest = hashlib.sha256(",".join(f"{sanitise.KINDS[k]}:{a}:{b}" for a, k, b, _ in spans).encode()).hexdigest()
            counts = [sum(s[1] == k for s in spans) for k in range(4)]
            assert [by_id[i].n_email, by_id[i].n_ip, by_id[i].n_card, by_id[i].n_phone, by_id[i].base_sha256] == [*counts, digest]


def test_sanitised_texts(spark):
    rows = sample(random.Random(4))
    out = sanitise.sanitise(frame(spark, rows))
    assert out.columns == ["doc_id", "text", "key", "near", "term", "base", "spans"]
    got = out.where("doc_id >= 200").collect()
    text = {r.doc_id: r.text for r in got}
    assert len(got) == len([i for i, _ in rows if i is not None and i >= 200])
    assert "Dr. quen* [removed] zabr* <[email]>" in text[200] and "again" in text[600]
    assert text[700] is None and text[701] == "" and text[702] == "[email]" and "anna" not in text[300] and "Anna [email]" in text[300] and "[phone] Zabri" in text[300]
    assert "10.0.0" not in out.where("doc_id = 7 AND text LIKE 'tag%'").first().text
    assert out.count() == len(rows)


def test_no_rows_and_long_text(spark):
    assert sanitise.inspect(frame(spark, [])).count() == 0
    long = "plain words here " * 60_000 + "me@example.org"
    assert sanitise.inspect(frame(spark, [(1, long), (2, None)])).where("doc_id = 1").first().spans == f"email:{len(long) - 14}:{len(long)}"
