"""Personal data in texts, and terms that give it away: corpus co-occurrence measures what they disclose."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillway.session import scratch_path
from rillway.sources.fields import named

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
# Words on either side of a protected entity that count as near it.
NEAR = 12
# A term discloses an entity if it carries so much of the information that the entity itself has ...
THRESHOLD = 0.9
# ... in at least so many different places: copies of a passage are one place.
PLACES = 3
# A task passes its word counts on when it holds so many.
COUNTS_HELD = 200_000
# Characters of a text whose words are listed at once.
SLICE = 1 << 20
BATCH_BYTES = 4 << 20

# The patterns, possessive and with an optional end: a stretch that cannot begin a match is passed
# over at once, so the time is linear in the text. Each gives what its plain form finds from left to right.
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++)?")
_IP = re.compile(r"[0-9]++(\.[0-9]++\.[0-9]++\.[0-9]++)?")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_BYTE = re.compile(r"0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_WORD = re.compile(r"[^\W_]+")
_BETWEEN = re.compile(r"[\W_]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        value = int(d) << (i & 1)
        total += value - 9 * (value > 9)
    return total % 10 == 0


Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) by kind, then start. A match that fails its check is dropped, not tried again."""
    found = []
    if "@" in text:
        found += [("email", m.start(), m.end()) for m in _EMAIL.finditer(text) if m.group(1)]
    if "." in text:
        found += [
            ("ip", m.start(), m.end()) for m in _IP.finditer(text) if m.group(1) and all(map(_BYTE.fullmatch, m.group().split(".")))
        ]
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


def entity(kind: str, value: str) -> str:
    """What a span stands for, however it is written."""
    return f"{kind}:{value.lower() if kind in ('email', 'ip') else _NOT_DIGIT.sub('', value)}"


def general_form(term: str) -> str | None:
    """The first half of a term, which stands for all terms that share it; shorter terms have none."""
    return term[: (len(term) + 1) // 2] + "*" if len(term) >= 4 else None


def number(key: str) -> int:
    return int.from_bytes(hashlib.blake2b(key.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def words_outside(text: str, spans: Sequence[Span]) -> Iterator[tuple[int, int]]:
    """Runs of letters and digits that touch no span."""
    held, at = sorted((a, b) for _, a, b in spans), 0
    for m in _WORD.finditer(text):
        while at < len(held) and held[at][1] <= m.start():
            at += 1
        if at == len(held) or held[at][0] >= m.end():
            yield m.span()


def near_terms(text: str, spans: Sequence[Span]) -> Iterator[tuple[str, str, int, int]]:
    """(entity, term, occurrences near it, place) for the words near an entity.

    An occurrence near several mentions of an entity counts once. ``place`` is a hash of the words on
    both sides, so that copies are one place; a term has a row per place. Words are read twice, and only
    those near a mention are held.
    """
    mentions, before = sorted(spans, key=lambda s: s[1]), []
    n = 0
    for a, _ in words_outside(text, spans):
        while len(before) < len(mentions) and mentions[len(before)][1] < a:
            before.append(n)
        n += 1
    before += [n] * (len(mentions) - len(before))
    terms, at = {}, 0
    for i, (a, b) in enumerate(words_outside(text, spans)):
        while at < len(before) and before[at] + NEAR < i:
            at += 1
        if at < len(before) and i >= before[at] - NEAR - 1:
            terms[i] = text[a:b].lower()
    close: dict[str, set[int]] = {}
    for (kind, a, b), middle in zip(mentions, before):
        close.setdefault(entity(kind, text[a:b]), set()).update(range(max(0, middle - NEAR), min(n, middle + NEAR)))
    for name, places in close.items():
        counted = Counter((terms[i], number(terms.get(i - 1, "") + "\n" + terms.get(i + 1, ""))) for i in places)
        for (term, place), times in counted.items():
            yield name, term, times, place


def count_terms(text: str, spans: Sequence[Span], counts: Counter) -> None:
    """Add the words of a text that touch no span, as written."""
    if spans:
        counts.update(text[a:b] for a, b in words_outside(text, spans))
        return
    begin = 0
    while begin < len(text):
        cut = _BETWEEN.search(text, begin + SLICE)
        end = cut.start() if cut else len(text)
        counts.update(_WORD.findall(text, begin, end))
        begin = end


_LONG = T.LongType()
_SPAN = T.StructType().add("kind", T.StringType()).add("start", T.IntegerType()).add("end", T.IntegerType())
_NEAR_NAMES = ("entity", "term", "general", "n", "place")
_NEAR = T.StructType([T.StructField(c, _LONG) for c in _NEAR_NAMES])
_SPAN_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
_NEAR_ARROW = pa.list_(pa.struct([(c, pa.int64()) for c in _NEAR_NAMES]))
_SCAN_NAMES = ["id", "text", "spans", "near", "term", "general", "n"]


def _number_or_none(key: str | None) -> int | None:
    return None if key is None else number(key)


def _listed(spans: Sequence[Span]) -> list[dict]:
    return [{"kind": k, "start": a, "end": b} for k, a, b in spans]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document, with text, spans and near terms if it holds personal data; and counts of all
    words outside of spans, summed within the task, in rows with ``n``."""
    counts: Counter = Counter()
    kind = None

    def documents(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        texts, spans, near = zip(*rows)
        none = pa.nulls(len(rows), pa.int64())
        columns = [ids, pa.array(texts, pa.string()), pa.array(map(_listed, spans), _SPAN_ARROW), pa.array(near, _NEAR_ARROW), none, none, none]
        return pa.record_batch(columns, _SCAN_NAMES)

    def totals() -> pa.RecordBatch:
        folded: Counter = Counter()
        for word, n in counts.items():
            folded[word.lower()] += n
        counts.clear()
        size = len(folded)
        columns = [
            pa.nulls(size, kind), pa.nulls(size, pa.string()), pa.nulls(size, _SPAN_ARROW), pa.nulls(size, _NEAR_ARROW),
            pa.array([number(t) for t in folded], pa.int64()),
            pa.array([_number_or_none(general_form(t)) for t in folded], pa.int64()),
            pa.array(list(folded.values()), pa.int64()),
        ]
        return pa.record_batch(columns, _SCAN_NAMES)

    for batch in batches:
        ids, texts = batch.columns
        kind = ids.type
        rows, size, begin = [], 0, 0
        for i, value in enumerate(texts):
            text = value.as_py() or ""
            spans = base_spans(text)
            count_terms(text, spans, counts)
            near = [
                {"entity": number(name), "term": number(t), "general": _number_or_none(general_form(t)), "n": n, "place": place}
                for name, t, n, place in (near_terms(text, spans) if spans else ())
            ]
            rows.append((text if spans else None, spans, near))
            size += len(text) if spans else 0
            if size > BATCH_BYTES or i + 1 == len(texts):
                yield documents(ids.slice(begin, len(rows)), rows)
                rows, size, begin = [], 0, i + 1
            if len(counts) > COUNTS_HELD:
                yield totals()
    if counts:
        yield totals()


_HIDDEN = T.StructType().add("spans", T.ArrayType(_SPAN)).add("text", T.StringType())


@F.arrow_udf(_HIDDEN)
def hide(text: pa.Array, spans: pa.Array, marks: pa.Array) -> pa.Array:
    """Base spans and, after them, those of marked terms; the text with both out of sight."""
    rows = []
    for t, s, m in zip(text, spans, marks):
        value, found = t.as_py(), [(x["kind"], x["start"], x["end"]) for x in s.as_py()]
        removed = {x["term"]: x["removed"] for x in sorted(m.as_py() or [], key=lambda x: x["removed"])}
        shown = {span: f"[{span[0].upper()}]" for span in found}
        known: dict[str, int] = {}
        terms = []
        for a, b in words_outside(value, found) if removed else ():
            term = value[a:b].lower()
            key = known.get(term)
            if key is None:
                key = known[term] = number(term)
            if key in removed:
                terms.append((TERM, a, b))
                shown[terms[-1]] = "" if removed[key] else general_form(term)
        pieces, at = [], 0
        for span in sorted(shown, key=lambda s: (s[1], -s[2])):
            if span[1] >= at:
                pieces += [value[at : span[1]], shown[span]]
            at = max(at, span[2])
        rows.append({"spans": _listed(found + terms), "text": "".join(pieces) + value[at:]})
    return pa.array(rows, pa.struct([("spans", _SPAN_ARROW), ("text", pa.string())]))


def _written(df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def disclosing_terms(near: DataFrame, counts: DataFrame, threshold: float = THRESHOLD, places: int = PLACES) -> DataFrame:
    """(entity, term, removed): terms that give an entity away, and whether also their general form does.

    With N words in the corpus, n(c) of them near the entity c, n(t) of them the term t and n(c, t) both, a term
    tells log(n(c, t) N / (n(c) n(t))) of the entity, which has the information log(N / n(c)). Their ratio is at
    most 1, for a term that occurs near the entity only; ``threshold`` of it or more discloses. The general form
    counts as the term that stands for all terms it could have been made of; if it still discloses, the term goes.
    ``near`` has (entity, term, general, n, place), ``counts`` (term, general, n); all joins are on keys, and a key's
    rows are summed in their tasks first.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    by_place = near.groupBy("entity", "term", "general", "place").agg(F.sum("n").alias("near"))
    pairs = by_place.groupBy("entity", "term", "general").agg(F.sum("near").alias("near"), F.count("*").alias("places"))
    sizes = near.groupBy("entity").agg(F.sum("n").alias("size"))
    share = lambda close, n: 1 + F.log2(F.col(close) / F.col(n)) / F.log2(F.lit(float(total)) / F.col("size"))
    open_terms = (
        pairs.filter(F.col("places") >= places)
        .join(counts.groupBy("term").agg(F.sum("n").alias("n")), "term")
        .join(sizes, "entity")
        .filter((F.col("size") < total) & (share("near", "n") >= threshold))
    )
    general_near = near.filter("general IS NOT NULL").groupBy("entity", "general").agg(F.sum("n").alias("general_near"))
    general_n = counts.filter("general IS NOT NULL").groupBy("general").agg(F.sum("n").alias("general_n"))
    measured = open_terms.join(general_near, ["entity", "general"], "left").join(general_n, "general", "left")
    still = F.coalesce(share("general_near", "general_n") >= threshold, F.lit(True))
    return measured.select("entity", "term", still.alias("removed"))


def sanitise(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = THRESHOLD, places: int = PLACES
) -> DataFrame:
    """(id, spans, text): personal data of each document with the terms that give it away.

    ``spans`` has kind, start, end in code points: email, ip, card, phone, each from left to right, then the
    terms. Terms are looked for in documents that hold the entity they disclose, so documents without personal
    data keep their text and have no spans. ``text`` has base spans as ``[KIND]``, terms in their general form or
    removed; it is null where nothing changes. A null text is empty; ids may be null or repeated, rows count
    each for itself; of equal rows each has its result; no rows give none; other columns are left out, whatever
    their names.

    One pass reads the texts; only those with personal data are written aside and met by their terms again.
    """
    rows = docs.select(named(id_col).alias("id"), named(text_col).cast("string").alias("text"))
    scanned = T.StructType([
        rows.schema["id"], T.StructField("text", T.StringType()), T.StructField("spans", T.ArrayType(_SPAN)), T.StructField("near", T.ArrayType(_NEAR)),
        T.StructField("term", _LONG), T.StructField("general", _LONG), T.StructField("n", _LONG),
    ])
    scan = _written(rows.mapInArrow(_scan, scanned).withColumn("row", F.monotonically_increasing_id()), "personal")
    counts = _written(scan.filter("n IS NOT NULL").groupBy("term", "general").agg(F.sum("n").alias("n")), "terms")
    holders = scan.filter("n IS NULL AND size(spans) > 0")
    near = holders.select("row", F.inline("near"))
    open_terms = disclosing_terms(near, counts, threshold, places)
    marked = near.select("row", "entity", "term").distinct().join(open_terms, ["entity", "term"])
    marks = marked.groupBy("row").agg(F.collect_set(F.struct("term", "removed")).alias("marks"))
    hidden = (
        holders.select("row", "id", "text", "spans").join(marks, "row", "left")
        .withColumn("hidden", hide("text", "spans", "marks"))
        .select("id", "hidden.spans", "hidden.text")
    )
    return hidden.unionByName(scan.filter("n IS NULL AND size(spans) = 0").select("id", "spans", "text"))


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")
