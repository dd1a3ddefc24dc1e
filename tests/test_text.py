import difflib
import random
import re
from itertools import accumulate

from pyspark.sql import functions as F

from rillway.functions.text import (
    StringOp, concat_as_text, contains_any, count_lines, escape_markup, lines_of, piece, safe_name, stem_key,
    string_ops, strip, unescape_markup,
)
from rillway.operators.cleaning import NO_CHANGE, PROGRAM_RULES, Rule, apply_rules, rule_notes
from rillway.operators.code_text import CODE_STARTS, code_lines, extract_code
from rillway.operators.line_diff import line_diff
from rillway.operators.token_text import corpus_blocks, next_turn, pad_tokens, prompt_dataset, token_blocks, tokens_of

ODD = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2003\u2028\u2029\u202f\u3000 ab`"


def odd_texts(n, seed=1, alphabet=ODD):
    rng = random.Random(seed)
    return ["", " ", "\n", "\r\n", "a\r\nb", "a\n\nb\n", "\x85"] + [
        "".join(rng.choice(alphabet) for _ in range(rng.randrange(12))) for _ in range(n)
    ]


def apply(spark, texts, *columns):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING")
    return [tuple(r)[1:] for r in sorted(df.select("i", *columns).collect())]


def test_strip_lines_and_tokens_follow_unicode(spark):
    texts = odd_texts(400)
    got = apply(spark, texts, strip(F.col("t")), lines_of(F.col("t")), count_lines(F.col("t")), tokens_of(F.col("t")))
    for text, row in zip(texts, got):
        assert row == (text.strip(), text.splitlines(), len(text.splitlines()), text.split()), repr(text)


def test_string_ops(spark):
    df = spark.createDataFrame([(" aB1\t<x> & 'q'", "o'neil mc kay")], "s STRING, n STRING")

    def one(op, col="s"):
        return string_ops(df, {col: op}).first()[col]

    s = " aB1\t<x> & 'q'"
    assert one(StringOp(case="lower")) == s.lower()
    assert one(StringOp(case="upper")) == s.upper()
    assert one(StringOp(trim="left")) == s.lstrip()
    assert one(StringOp(digits="only")) == "1"
    assert one(StringOp(digits="remove")) == s.replace("1", "")
    assert one(StringOp(remove="tab")) == s.replace("\t", "")
    assert one(StringOp(remove="space")) == s.replace(" ", "")
    assert one(StringOp(mask="escape", trim="both")) == "aB1\t&lt;x&gt; &amp; &apos;q&apos;"
    assert one(StringOp(pad=("left", "0", 20))) == s.rjust(20, "0")
    assert one(StringOp(pad=("right", "0", 3))) == s
    assert one(StringOp(init_cap=True), "n") == "O'neil Mc Kay"
    assert string_ops(df, {"s": StringOp(case="upper", out="u")}).columns == ["s", "n", "u"]


def test_escaping_is_undone(spark):
    texts = ["<a href=\"x\">&amp;'&lt;", "&&amp;lt;", ""]
    back = apply(spark, texts, unescape_markup(escape_markup(F.col("t"))))
    assert [r[0] for r in back] == texts


def test_names_pieces_and_tokens(spark):
    texts = ["Job 1-\xe9.x", "REPORT_converted", "a_corrected_converted", "converted"]
    got = apply(spark, texts, safe_name(F.col("t")), stem_key(F.col("t")))
    for text, (safe, stem) in zip(texts, got):
        assert safe == re.sub(r"[^a-zA-Z0-9_\-]", "_", text)
        plain = re.sub("[^a-zA-Z0-9]", "_", text).lower()
        assert stem == re.sub("(_converted|_corrected)$", "", plain)
    rows = apply(spark, ["a,b", "a", ""], piece(F.col("t"), ",", 1), concat_as_text(F.col("i"), F.col("t")))
    assert rows == [("b", "0a,b"), (None, "1a"), (None, "2")]
    assert apply(spark, ["x.join(y", "x"], contains_any(F.col("t"), [".join(", "z"])) == [(True,), (False,)]
    assert apply(spark, ["a|b"], piece(F.col("t"), "|", 1)) == [("b",)]


# The rules as patterns of the other engine.
PYTHON_PATTERNS = (re.escape("==="), r"\.with\s*==.*", r"\\\s*#.*", re.escape('.mode("overwrite") \\'))


def rules_by_hand(code):
    stages = [code]
    for pattern, rule in zip(PYTHON_PATTERNS, PROGRAM_RULES):
        put = "\\" if rule.regex and rule.put.startswith("\\") else rule.put
        stages.append(re.sub(pattern, lambda _: put, stages[-1]))
    fired = [rule.name for rule, old, new in zip(PROGRAM_RULES, stages, stages[1:]) if old != new]
    return stages[-1], fired or [NO_CHANGE]


def test_rules_against_the_other_regex_engine(spark):
    rng = random.Random(5)
    parts = ["a === b", ".with ==x", ".with\u2003== y\u2028z", "\\ # note", "\\\n  #c\rd", '.mode("overwrite") \\', "\n", " ", "=", "#", "\\"]
    texts = ["", "plain"] + ["".join(rng.choice(parts) for _ in range(rng.randrange(6))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING")
    for row in apply_rules(df, "t").collect():
        assert (row.corrected, row.rules) == rules_by_hand(row.t), repr(row.t)


def test_own_rules_and_notes(spark, rows):
    df = spark.createDataFrame([(1, "a.b"), (2, "x"), (3, None)], "k INT, t STRING")
    cleaned = apply_rules(df, "t", [Rule("dots", ".", "-"), Rule("letters", "[ab]", "$0$0", regex=True)], out="o", fired="f")
    assert rows(cleaned.select("k", "o", F.array_join("f", "|"))) == [
        (1, "aa-bb", "dots|letters"), (2, "x", NO_CHANGE), (3, None, NO_CHANGE),
    ]
    notes = rule_notes(apply_rules(spark.createDataFrame([(1, "a===b"), (2, "")], "k INT, t STRING"), "t"), "k")
    assert rows(notes) == [(1, "Replace ===", "PySpark uses '==' not '==='."), (2, NO_CHANGE, "No rule-based changes applied")]


def code_by_hand(text):
    lines = text.splitlines()
    fences = [line.strip()[:3] == "```" for line in lines]
    starts = tuple(s.replace("\\", "") for s in CODE_STARTS)
    kept = [
        line
        for line, fence, seen in zip(lines, fences, accumulate(fences))
        if not fence and (seen % 2 == 1 or line.lstrip().startswith(starts))
    ]
    return "\n".join(kept).strip()


def test_code_extraction_against_brute_force(spark):
    rng = random.Random(9)
    parts = ["```", "  ```py", "\u2003```", "df = 1", "\u3000 import os", "prose", "", "col(x", "column", "select", "x ```", "\x1fspark", "from x"]
    ends = ["\n", "\r\n", "\r", "\x85", "\u2028", "\x1c"]
    texts = ["", "```", "```\n", "a\n```\nb", "```\n```\n```\nx"]
    for _ in range(400):
        texts.append("".join(rng.choice(parts) + rng.choice(ends) for _ in range(rng.randrange(8))) + rng.choice(["", "df"]))
    got = apply(spark, texts, extract_code(F.col("t")))
    for text, (code,) in zip(texts, got):
        assert code == code_by_hand(text), repr(text)


def in_order(pairs):
    """Of (i, j) pairs the longest increasing ones, by quadratic search; each goes on with the earliest that can."""
    pairs = sorted(pairs)
    reach = [1] * len(pairs)
    for k in range(len(pairs) - 1, -1, -1):
        reach[k] += max((reach[m] for m in range(k + 1, len(pairs)) if pairs[m][1] > pairs[k][1]), default=0)
    need, last, out = max(reach, default=0), -1, []
    for (i, j), r in zip(pairs, reach):
        if r == need and j > last:
            out.append((i, j))
            need, last = need - 1, j
    return out


def kept_by_hand(old, new):
    """Pairs of lines that stay: those that occur once, then between them the n-th copy with the n-th copy."""
    head = next((k for k, (x, y) in enumerate(zip(old, new)) if x != y), min(len(old), len(new)))
    tail = 0
    while tail < min(len(old), len(new)) - head and old[-1 - tail] == new[-1 - tail]:
        tail += 1
    ends = [(head - 1, head - 1), (len(old) - tail, len(new) - tail)]

    def between(kept):
        for (i, j), (i2, j2) in zip(sorted([*kept, *ends]), sorted([*kept, *ends])[1:]):
            yield range(i + 1, i2), range(j + 1, j2)

    def matched(rows, cols, unique):
        seen = [{}, {}]
        for side, text, places in ((0, old, rows), (1, new, cols)):
            for k in places:
                seen[side].setdefault(text[k], []).append(k)
        for line, places in seen[0].items():
            others = seen[1].get(line, [])
            if not unique or len(places) == len(others) == 1:
                yield from zip(places, others)

    kept = in_order(matched(range(head, len(old) - tail), range(head, len(new) - tail), True))
    kept += [p for rows, cols in between(kept) for p in in_order(matched(rows, cols, False))]
    same = [(k, k) for k in range(head)] + [(len(old) - k, len(new) - k) for k in range(1, tail + 1)]
    return sorted(kept + same)


def diff_by_hand(before, after):
    """Rows of the differences, with the hunks that difflib makes of the lines that stay."""
    old, new = before.splitlines(), after.splitlines()
    codes, i, j = [], 0, 0
    for a, b in [*kept_by_hand(old, new), (len(old), len(new))]:
        if a > i or b > j:
            codes.append(("replace" if a > i and b > j else "delete" if a > i else "insert", i, a, j, b))
        if a < len(old) and codes and codes[-1][0] == "equal":
            codes[-1] = ("equal", codes[-1][1], a + 1, codes[-1][3], b + 1)
        elif a < len(old):
            codes.append(("equal", a, a + 1, b, b + 1))
        i, j = a + 1, b + 1
    matcher = difflib.SequenceMatcher(None, old, new)
    matcher.opcodes = codes
    rows, span = [], lambda a, b: f"{a + 1}" if b - a == 1 else f"{a},0" if a == b else f"{a + 1},{b - a}"
    for hunk, group in enumerate(matcher.get_grouped_opcodes(3), 1):
        (_, a, _, b, _), (_, _, c, _, d) = group[0], group[-1]
        rows.append((hunk, a, "HUNK", "", f"@@ -{span(a, c)} +{span(b, d)} @@"))
        for tag, i1, i2, j1, j2 in group:
            if tag != "equal":
                rows += [(hunk, k, "DIFF_DELETE", old[k], "") for k in range(i1, i2)]
                rows += [(hunk, k, "DIFF_INSERT", "", new[k]) for k in range(j1, j2)]
    return [] if len(codes) == 1 and codes[0][0] == "equal" else rows


def patched(before, rows):
    """The text that the rows make of ``before``, by their positions alone."""
    lines = before.splitlines()
    gone = {pos for _, pos, rule, *_ in rows if rule == "DIFF_DELETE"}
    out = [line for k, line in enumerate(lines) if k not in gone]
    for _, pos, rule, _, line in rows:
        if rule == "DIFF_INSERT":
            out.insert(pos, line)
    return out


def common_length(old, new):
    best = [0] * (len(new) + 1)
    for x in old:
        before = best[:]
        for j, y in enumerate(new):
            best[j + 1] = before[j] + 1 if x == y else max(best[j], before[j + 1])
    return best[-1]


def edited_texts():
    rng = random.Random(11)
    yield from [
        ("a\nb\nc", "a\nc\nd"), ("same", "same"), (None, "++x\n--y"), ("x", None), ("", ""), (None, None), ("a\na\nb\na", "a\nb"),
        ("\n".join(["x"] * 300 + ["y"]), "\n".join(["x"] * 250 + ["z", "x"])), ("a\n", "a"), ("a\r\nb", "a\nb"), ("\n\n\n", "\n"),
    ]
    for n in range(60):
        lines = [f"line {rng.randint(0, 8 if n % 2 else 10**6)}" for _ in range(rng.randint(0, 60))]
        other = [x for x in lines if rng.random() > 0.1]
        for _ in range(rng.randint(0, 6)):
            place = rng.randint(0, len(other))
            how = rng.random()
            if how < 0.5:
                other.insert(place, f"new {rng.randint(0, 3 if n % 2 else 10**6)}")
            else:
                block = other[place : place + rng.randint(1, 8)]
                del other[place : place + len(block)]
                at = rng.randint(0, len(other))
                other[at:at] = block
        yield "\n".join(lines), "\n".join(other)
    shuffled = [str(i) for i in range(400)]
    rng.shuffle(shuffled)
    yield "\n".join(map(str, range(400))), "\n".join(shuffled)


def test_line_diff_rows(spark):
    texts = list(edited_texts())
    df = spark.createDataFrame([(i, b, a) for i, (b, a) in enumerate(texts)], "k INT, b STRING, a STRING").repartition(4)
    diff = line_diff(df, "k", "b", "a")
    got = {}
    for r in diff.collect():
        got.setdefault(r.k, []).append((r.seq, r.hunk, r.pos, r.rule, r.before, r.after))
    for k, (before, after) in enumerate(texts):
        rows = [r[1:] for r in sorted(got.get(k, []))]
        before, after = before or "", after or ""
        assert rows == diff_by_hand(before, after), (before, after)
        assert patched(before, rows) == after.splitlines()
        old, new = before.splitlines(), after.splitlines()
        if len(set(old)) == len(old) and len(set(new)) == len(new):
            assert sum(r[2] == "DIFF_DELETE" for r in rows) == len(old) - common_length(old, new)
    assert "Python" not in diff._jdf.queryExecution().executedPlan().toString()


def test_line_diff_keeps_rows_of_one_key_apart(spark):
    df = spark.createDataFrame([(1, "a", "b"), (1, "a", "c"), (None, "x", "y"), (None, "x", "y")], "k INT, before STRING, after STRING")
    rows = [(r.k, r.rule, r.before, r.after) for r in line_diff(df, "k", "before", "after").collect() if r.rule != "HUNK"]
    assert sorted(rows, key=repr) == sorted(
        [(1, "DIFF_DELETE", "a", ""), (1, "DIFF_INSERT", "", "b"), (1, "DIFF_DELETE", "a", ""), (1, "DIFF_INSERT", "", "c")]
        + [(None, "DIFF_DELETE", "x", ""), (None, "DIFF_INSERT", "", "y")] * 2, key=repr,
    )
    assert line_diff(df.limit(0), "k", "before", "after").collect() == []


def test_token_blocks_cover_the_whole_text(spark):
    texts = odd_texts(150, seed=2) + [" ".join(f"w{i}" for i in range(n)) for n in (1, 3, 4, 5, 8, 9, 1000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING")
    got = {}
    for r in token_blocks(df, "i", "t", size=4).collect():
        got.setdefault(r.i, {})[r.block] = (r.tokens, r.n_tokens, r.complete)
    for i, text in enumerate(texts):
        tokens = text.split()
        want = {b: (tokens[s : s + 4], len(tokens[s : s + 4]), len(tokens[s : s + 4]) == 4)
                for b, s in enumerate(range(0, len(tokens), 4))}
        assert got.get(i, {}) == want, repr(text)


def test_corpus_blocks_go_on_over_documents(spark):
    rng = random.Random(3)
    texts = odd_texts(150, seed=2) + [" ".join(f"w{i}" for i in range(n)) for n in (1, 3, 4, 5, 8, 9, 1000, 0, 1, 1, 1)] + [None]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "i INT, t STRING").repartition(5).withColumns({c: F.lit("z") for c in ("_key", "_end", "block", "tokens")})
    tokens = [w for text in texts for w in (text or "").split()]
    for size in (1, 4, 128, 5000):
        got = {r.block: (r.tokens, r.n_tokens, r.complete) for r in corpus_blocks(df, "i", "t", size=size).collect()}
        parts = [tokens[at : at + size] for at in range(0, len(tokens), size)]
        assert got == {b: (part, len(part), len(part) == size) for b, part in enumerate(parts)}
    assert corpus_blocks(df.limit(0), "i", "t").collect() == []


def test_code_lines_of_rows_equal_those_of_texts(spark):
    rng = random.Random(5)
    pieces = ["```", "  ```py", "import os", " text", "", "df = 1", "select x", "a ``` b", "```x```", "x"]
    texts = ["\n".join(rng.choice(pieces) for _ in range(rng.randint(0, 60))) for _ in range(40)]
    texts.append("\n".join(["```", *(f"line {i}" for i in range(5000)), "```", "not code", "import x"]))
    rows = [(d, 10 * k, line) for d, text in enumerate(texts) for k, line in enumerate(text.split("\n"))]
    rows += [(None, 1, "```"), (None, 2, "inside"), (None, 3, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc INT, pos INT, line STRING").repartition(6)
    kept = {}
    for r in sorted(code_lines(df, "doc", "pos", "line").collect(), key=lambda r: (r.doc is None, r.doc, r.pos)):
        kept.setdefault(r.doc, []).append(r.line)
    assert kept.pop(None) == ["inside", None]
    # A text keeps its lines together and strips them as a whole.
    want = apply(spark, texts, extract_code(F.col("t")))
    assert ["\n".join(kept.get(d, [])).strip() for d in range(len(texts))] == [code.strip() for (code,) in want]


def test_a_very_long_text(spark):
    n = 300_000
    df = spark.range(1).select("id", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: i.cast("string")), " ").alias("t"))
    blocks = token_blocks(df, "id", "t")
    assert blocks.agg(F.sum("n_tokens"), F.count("block"), F.max(F.element_at("tokens", -1).cast("int"))).first()[:] == (n, -(-n // 128), n)


def test_padding(spark):
    got = apply(spark, ["a b c", "a", ""], pad_tokens(tokens_of(F.col("t")), 2, "<pad>"))
    assert got == [(["a", "b"],), (["a", "<pad>"],), (["<pad>", "<pad>"],)]


def test_prompts(spark, rows):
    turns = spark.createDataFrame(
        [(1, 0, "system", "s"), (1, 1, "user", " Q1 "), (1, 2, "assistant", "A1"), (1, 3, "user", "Q2"), (1, 4, "user", "Q3"),
         (1, 5, "assistant", "\u2003"), (2, 2, "assistant", "other")],
        "conv INT, turn INT, role STRING, text STRING",
    )
    pairs = next_turn(turns, "conv", "turn", "role", "user", "assistant", "text")
    assert rows(pairs) == [(1, 1, " Q1 ", "A1"), (1, 4, "Q3", "\u2003")]
    assert rows(prompt_dataset(pairs, "prompt", "completion")) == [("q1", "a1")]


def test_corpus_blocks_count_texts_once_and_cut_them_before_filters(spark):
    df = spark.createDataFrame([(i, "a b c\td " * i) for i in range(40)], "i long, t string")
    blocks = corpus_blocks(df, "i", "t", size=7)
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert "regexp_count" not in plan and not any("split(" in line for line in plan.splitlines() if "Filter " in line)
    got = sorted(blocks.collect(), key=lambda r: r.block)
    words = [w for i in range(40) for w in ("a b c\td " * i).split()]
    assert [w for r in got for w in r.tokens] == words and all(r.n_tokens == 7 for r in got[:-1])
