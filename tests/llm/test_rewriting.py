"""Repaired conversations, hidden personal data, fill-in-middle: each against brute force, over odd cases."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from edge_rows import documents, frame, prose
from oracle_check import compare, connect
from rillway.llm import conversation_repair as cr
from rillway.llm import disclosure as dc
from rillway.llm import fill_in_middle as fm
from rillway.llm.conversation_queries import op11_survivor_viterbi
from rillway.llm.text_queries import op12_disclosure, op13_boundary_set


@pytest.mark.parametrize("name", ["op11_survivor_viterbi", "op13_boundary_set"])
def test_query_equals_sql(spark, name):
    sf_dir = "/root/testdata/sf0.001"
    query, sql = __spark_entry__.queries()[name], __spark_entry__.oracle_sql()[name]
    assert compare(spark, connect(sf_dir), name, query, sql, sf_dir) == []


# --- fill-in-middle


def boundary_texts():
    rng = random.Random(3)
    yield from ("", "a", "é", "\U0001f600", "aé" * 40, "x" * 70_000, "é" * 40_000, "\U0001f600" * 30_000)
    yield "".join(rng.choice("ab é\U0001f600") for _ in range(90_000))
    yield "x" * 65_535 + "é" + "y" * 10
    yield "".join("é" * rng.randint(1, 400) + "z" * rng.randint(1, 400) for _ in range(600))
    yield ("a" * 300 + "é") * 300


def test_boundaries_select_every_code_point():
    kinds = set()
    for text in boundary_texts():
        data = np.frombuffer(text.encode(), np.uint8)
        found = fm.Boundaries(data)
        kinds |= {type(c) for c in found.containers}
        starts = [0, *itertools.accumulate(len(c.encode()) for c in text)]
        assert len(found) == len(text)
        for k in {0, 1, 2, 3, len(text) // 2, max(0, len(text) - 1), len(text), *range(0, len(text), 97)}:
            if k <= len(text):
                assert found.select(k) == starts[k]
    assert kinds == {fm.Runs, fm.Array, fm.Bitmap}


def test_each_container_selects_its_members():
    rng = np.random.default_rng(1)
    for size, share in ((1, 1.0), (65_536, 1.0), (65_536, 0.5), (65_536, 0.01), (40_000, 0.2), (700, 0.5)):
        mask = rng.random(size) < share
        mask[0] = True
        members = np.flatnonzero(mask)
        found = fm.container(mask)
        assert [found.select(int(k)) for k in range(0, len(members), 7)] == members[::7].tolist()


def middle(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (n, "plain", None, None, text)
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}")
    return (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle_on_odd_rows(spark):
    rng = random.Random(9)
    rows = documents() + [(1000 + i, t) for i, t in enumerate(boundary_texts())]
    rows += [(2000, "has <M> in it"), (2001, "<P"), (2002, "<<P>"), (-5, "negative id"), (2003, "S><M" * 30), (2004, "<" * 50 + ">" * 50)]
    rows += [(3000 + i, prose(rng, 30)) for i in range(300)]
    out = fm.fill_in_middle(frame(spark, rows).withColumns({c: F.lit(1) for c in ("n", "form", "output", "cut", "h")}))
    got = out.withColumn("back", fm.restore(F.col("form"), F.col("output"))).collect()
    assert Counter(tuple(r)[:6] for r in got) == Counter((i, *middle(i, t)) for i, t in rows)
    assert Counter((r.id, r.back) for r in got) == Counter((i, t or "") for i, t in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fm.fill_in_middle(frame(spark, rows=[])).collect() == []


def test_fill_in_middle_cuts_invalid_bytes(spark):
    df = spark.createDataFrame([(7, bytearray(b"\xa9\xa9ab\xc3")), (8, bytearray(b"\xff" * 9))], "doc_id long, raw binary")
    out = fm.fill_in_middle(df.select("doc_id", F.col("raw").cast("string").alias("text")))
    back = out.select("id", fm.restore(F.col("form"), F.col("output")).cast("binary").alias("b")).collect()
    assert {r.id: bytes(r.b) for r in back} == {7: b"\xa9\xa9ab\xc3", 8: b"\xff" * 9}


# --- conversations


def faulty(rows):
    """Rows (turn, role, text) of one conversation, in order, with the first fault of each."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    out, seen = [], set()
    for turn, role, text in rows:
        body = text.rstrip(cr.WHITE)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else None if body[-1] in cr.ENDS else "truncated"
        seen.add((role, text))
        out.append((turn, role, text, fault))
    return out


def every_repair(rows):
    """(cost, edits, repaired) of all ways to edit, inserted turns anywhere, that cost no more than to delete all rows."""
    def walk(i, cost, audit, repaired, inserted):
        if cost > 3 * len(rows):
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(r[0][:1] or "?" for r in repaired)):
            yield cost, audit, repaired
        if inserted < 2:
            for role in ("user", "assistant"):
                yield from walk(i, cost + 2, audit + "I", [*repaired, (role, "")], inserted + 1)
        if i < len(rows):
            _, role, text, fault = rows[i]
            yield from walk(i + 1, cost + 3, audit + "D", repaired, 0)
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                yield from walk(i + 1, cost + extra, audit + "K", [*repaired, (role, text)], 0)
                for to in ("user", "assistant"):
                    yield from walk(i + 1, cost + 2 + extra, audit + "R", [*repaired, (to, text)], 0)
    return min(walk(0, 0, "", [], 0), key=lambda r: r[:2])


def plain_viterbi(rows):
    """Whole survivors, inserted turns anywhere."""
    step, best = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}, {0: (0, "", ())}

    def offer(found, q, new):
        if q not in found or new[:2] < found[q][:2]:
            found[q] = new

    def widen(found):
        for _ in range(3):
            for p, (cost, audit, out) in list(found.items()):
                for i, q in step[p].items():
                    if i != "s":
                        offer(found, q, (cost + 2, audit + "I", (*out, ("user" if i == "u" else "assistant", ""))))
        return found

    widen(best)
    for _, role, text, fault in rows:
        found = {}
        for p, (cost, audit, out) in best.items():
            offer(found, p, (cost + 3, audit + "D", out))
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                for i, q in step[p].items():
                    if role[:1] == i:
                        offer(found, q, (cost + extra, audit + "K", (*out, (role, text))))
                    if i != "s":
                        offer(found, q, (cost + extra + 2, audit + "R", (*out, ("user" if i == "u" else "assistant", text))))
        best = widen(found)
    return min(best[q] for q in (0, 3) if q in best)


def repaired(rows):
    made = list(cr.edits_of(iter(rows)))
    return sum(m[-1] for m in made), "".join(m[0] for m in made), [(m[2], m[3]) for m in made if m[2] is not None]


ROLES = ["user", "assistant", "system", "tool", "", " "]


def some_rows(rng, n, roles=ROLES, clean=0.5):
    texts = ["", " \n", "Yes.", "no", "Why?", "cut off "]
    return faulty(
        (rng.choice([None, 0, 1, 2, 3, 4, 5, 9]), rng.choice(roles), f"t{i}." if rng.random() < clean else rng.choice(texts)) for i in range(n)
    )


def test_repairs_are_the_cheapest_of_all():
    rng = random.Random(4)
    for n in [0, 1, 2, 3] * 40 + [4] * 12:
        rows = some_rows(rng, n)
        assert repaired(rows) == every_repair(rows), rows


def test_long_repairs_equal_whole_survivors():
    rng = random.Random(8)
    for n in range(300):
        rows = some_rows(rng, rng.randint(5, 40), roles=rng.choice([ROLES, ["user"], ["tool"], ["assistant", "user"], ROLES[:3]]), clean=rng.random())
        cost, audit, out = plain_viterbi(rows)
        assert repaired(rows) == (cost, audit, list(out)), rows


def test_edits_leave_early_and_runs_take_no_room(monkeypatch):
    def size(search):
        nodes = set()
        for _, node in search.best.values():
            while node is not None and id(node) not in nodes:
                nodes.add(id(node))
                node = node.parent
        return len(nodes)

    search, emitted, largest = cr.Survivors(), 0, 0
    for i in range(20_000):
        emitted += sum(run for _, run in search.push("ua"[i % 2], i % 7 == 3, i % 5 == 0))
        largest = max(largest, size(search))
    assert emitted > 19_900 and largest < 40
    # Which edit the first row gets depends on the last one here, yet the tree stays small.
    search = cr.Survivors()
    certain = [list(search.push("t", False, False)) for _ in range(5000)]
    assert not any(certain[10:]) and size(search) < 10
    blanks = cr.Survivors()
    list(blanks.push("u", False, False))
    for _ in range(5000):
        list(blanks.push("a", True, False))
    assert size(blanks) < 10


def test_unresolved_texts_wait_in_a_file():
    rows = faulty((i, "tool", f"text é {i}.") for i in range(41))
    waiting = cr.Waiting(most=30)
    for row in rows:
        waiting.push(row[:2], row[2])
    assert waiting.held <= 30 and waiting.file
    assert [waiting.pop() for _ in rows] == [(*r[:2], r[2]) for r in rows] and waiting.file is None
    assert repaired(rows)[:2] == plain_viterbi(rows)[:2]


def damaged(rows):
    """The rows (conv_id, turn, role, text) of a table after damage, by conversation."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        kept = out[conv]
        if how == 0:
            continue
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        kept += [(turn, "user" if how == 4 else role, text)] * (2 if how == 3 else 1)
    return out


def want_summary(rows):
    rows = faulty(rows)
    turns = [r[0] for r in rows if r[0] is not None]
    faults = Counter(r[3] for r in rows)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, out = plain_viterbi(rows)
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, digest


def test_conversations_on_odd_rows(spark, tmp_path):
    rng = random.Random(12)
    rows = []
    for conv in [*range(120), None]:
        for i in range(rng.randint(1, 14)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            rows.append((conv, rng.choice([i, i, i, None, 40]), role, rng.choice([f"words {i}.", f"words {i}", "Same.", "", " ", None, "é!\n"])))
    rows += [(500, i, "ua"[i % 2] and ("user", "assistant")[i % 2], "long " * 40_000 + "." * (i % 3)) for i in range(6)]
    rows += [(501, i, "user", "again.") for i in range(400)]
    dropped = next(c for c in range(600, 900) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "Gone."))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    df = df.withColumns({c: F.lit(c) for c in ("conv", "place", "edit", "fault", "seen", "how", "copy")})
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r)[1:] for r in op11_survivor_viterbi(spark, str(tmp_path)).collect()}
    want = {conv: want_summary(kept) for conv, kept in damaged(rows).items()}
    assert got == want
    assert got[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    edits = cr.repair(df).collect()
    roles = defaultdict(str)
    for e in sorted((e for e in edits if e.role is not None), key=lambda e: (str(e.conv), e.place)):
        roles[e.conv] += e.role[0]
    assert all(re.fullmatch("s?(ua)+", r) for r in roles.values())
    empty = cr.repair(df.limit(0))
    assert empty.collect() == [] and cr.summarise(empty).collect() == []


# --- personal data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m.group() if c in "0123456789"]
            total = sum(d if i % 2 == 0 else 2 * d - 9 * (2 * d > 9) for i, d in enumerate(reversed(digits)))
            if {
                "email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else True,
                "card": 13 <= len(digits) <= 19 and total % 10 == 0, "phone": 9 <= len(digits) <= 15,
            }[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(2)
    for alphabet in ("ab@.-_ ", "01259. -", "+0123456789 ()-.", "a@b.c1.2.3.4 +44", "é٣@a.b1 "):
        for _ in range(4000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
            assert dc.base_spans(text) == plain_spans(text), text
    cards = [f"{rng.randrange(10**14, 10**16)}" for _ in range(3000)]
    assert [dc.base_spans(c) for c in cards] == [plain_spans(c) for c in cards] and any(dc.base_spans(c) for c in cards)
    assert dc.base_spans("a@b.c_d@e.f x@y 0255.1.2.3.4.5.6.7 256.1.1.1") == [("email", 0, 5), ("email", 5, 11), ("ip", 16, 26), ("ip", 27, 34)]


def test_base_spans_take_linear_time():
    for piece in ("a", "1", "+1", "1.", "a@", "+1 (", "1-", "a.b@c"):
        dc.base_spans(piece * 400_000)


def planted():
    """Five documents in which one unusual word goes with an address, among texts that use other words."""
    rng = random.Random(6)
    rows = [(i, prose(rng, 80)) for i in range(60)]
    for i in range(5):
        rows.append((100 + i, f"{prose(rng, 30)} Zebulon {prose(rng, 4)} quartz@example.com {prose(rng, 2)} fox {prose(rng, 30)}{' zebulon' * (i == 0)}"))
    # Copies are one place, however many.
    rows += [(200 + i, "the very same passage with marigold near lily@example.com and no more") for i in range(9)]
    rows += [(300, "zebulon without the address"), (301, "call +1 (743) 555-3824 or 4539 1488 0343 6467, 10.0.0.1;10.0.0.2"), (302, "fox " * 3)]
    # Half of a term stands for many others: it is enough to name that half.
    rows += [(400 + i, f"{prose(rng, 5)} zebu zebulous zebuline {prose(rng, 5)} zebulary") for i in range(40)]
    return rows


def brute_force(rows, threshold=dc.THRESHOLD, most=dc.PLACES):
    texts = [(t or "", dc.base_spans(t or "")) for _, t in rows]
    words = []
    for t, spans in texts:
        words.append([(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"[^\W_]+", t) if not any(a < m.end() and b > m.start() for _, a, b in spans)])
    total = sum(map(len, words))
    n, general_n = Counter(w for ws in words for *_, w in ws), Counter(dc.general_form(w) for ws in words for *_, w in ws)
    near, general_near, size, places = Counter(), Counter(), Counter(), defaultdict(set)
    close = []
    for (t, spans), ws in zip(texts, words):
        here = defaultdict(set)
        for kind, a, b in spans:
            middle = sum(s < a for s, *_ in ws)
            here[dc.entity(kind, t[a:b])] |= set(range(max(0, middle - dc.NEAR), min(len(ws), middle + dc.NEAR)))
        close.append({(c, ws[i][2]) for c, at in here.items() for i in at})
        for c, at in here.items():
            for i in at:
                w = ws[i][2]
                near[c, w] += 1
                general_near[c, dc.general_form(w)] += 1
                size[c] += 1
                places[c, w].add((ws[i - 1][2] if i else "", ws[i + 1][2] if i + 1 < len(ws) else ""))

    def share(c, close, n):
        return math.log2(close * total / (size[c] * n)) / math.log2(total / size[c])

    flagged = {}
    for (c, w), k in near.items():
        if len(places[c, w]) >= most and share(c, k, n[w]) >= threshold:
            g = dc.general_form(w)
            flagged[c, w] = g is None or share(c, general_near[c, g], general_n[g]) >= threshold
    out = []
    for (t, spans), ws, pairs in zip(texts, words, close):
        marks = defaultdict(bool)
        for c, w in pairs:
            if (c, w) in flagged:
                marks[w] |= flagged[c, w]
        out.append(([*spans, *(("term", a, b) for a, b, w in ws if w in marks)], dict(marks)))
    return flagged, out


def test_disclosing_terms_equal_brute_force(spark):
    rows = planted()
    flagged, want = brute_force(rows)
    assert ("email:quartz@example.com", "zebulon") in flagged and not any(w == "marigold" for _, w in flagged)
    got = defaultdict(list)
    for r in dc.sanitise(frame(spark, rows).withColumns({c: F.lit(1) for c in ("row", "near", "spans", "term", "n")})).collect():
        got[r.id].append(([tuple(s) for s in r.spans], r.text))
    assert {i: [spans for spans, _ in found] for i, found in got.items()} == {i: [spans] for (i, _), (spans, _) in zip(rows, want)}
    assert got[300] == [([], None)] and got[302] == [([], None)]
    text = got[100][0][1]
    assert "ebulon" not in text and "zebu*" in text and "[EMAIL]" in text and "quartz" not in text
    assert got[301][0][1] == "call [PHONE] or [CARD], [IP];[IP]"
    strict = dc.sanitise(frame(spark, rows), threshold=0.2, places=2).collect()
    assert {r.id: [tuple(s) for s in r.spans] for r in strict} == {i: spans for (i, _), (spans, _) in zip(rows, brute_force(rows, 0.2, 2)[1])}


def test_personal_data_on_odd_rows(spark, tmp_path):
    rng = random.Random(1)
    extra = [(900, "x" * 5000 + " a@b.c " + "word " * 300_000), (901, "@" * 50), (902, "a@b.cé +1234567890"), (None, "me@here.org"), (902, "me@here.org"), (902, "me@here.org")]
    rows = documents() + extra + [(1000 + i, prose(rng, 20) + " me@here.org " + prose(rng, 20)) for i in range(10)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(tuple(r) for r in op12_disclosure(spark, str(tmp_path)).collect())
    joined = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    want = Counter()
    for (i, text), (spans, _) in zip(rows, brute_force(rows)[1]):
        base = plain_spans(text or "")
        counts = [sum(k == kind for k, *_ in base) for kind in dc.KINDS]
        want[i, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)] += 1
    assert got == want
    assert dc.sanitise(frame(spark, rows=[])).collect() == []


def test_fill_query_columns(spark):
    assert op13_boundary_set(spark, "/root/testdata/sf0.001").columns == [
        "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"
    ]
