"""Token blocks and prompt rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillway.functions.text import NOT_SPACE, SPACE, strip
from rillway.operators.arrays import rows_of
from rillway.operators.ordering import running_totals
from rillway.session import scratch_path
from rillway.sources.fields import named

# Fixed value: tokens per block.
BLOCK = 128


def tokens_of(text: Column) -> Column:
    """White-space tokens; none for blank text."""
    return F.array_remove(F.split(text, SPACE + "+"), "")


def token_blocks(df: DataFrame, key: str, text: str, size: int = BLOCK) -> DataFrame:
    """Blocks of ``size`` tokens per document; the last one may be shorter and is flagged.

    One pass of a pattern cuts the text into runs of up to ``size`` tokens, and the runs are exploded
    within the row: no shuffle, and work that grows with the length of the text only. (Slicing a
    token array would copy it once per block.)
    """
    run = f"(?:{NOT_SPACE}++{SPACE}*+){{1,{size}}}"
    runs = F.regexp_extract_all(named(text), F.lit(run), F.lit(0))
    blocks = rows_of(df, key, runs, item="_run", position="block")
    n = F.size("tokens")
    return blocks.select(named(key), "block", tokens_of(F.col("_run")).alias("tokens")).select(
        named(key), "block", "tokens", n.alias("n_tokens"), (n == size).alias("complete")
    )


def corpus_blocks(df: DataFrame, key: str, text: str, size: int = BLOCK) -> DataFrame:
    """(block, tokens, n_tokens, complete): all texts in order of ``key``, cut into blocks of ``size`` tokens.

    Blocks go on from one document to the next; only the last one of the corpus may be incomplete. ``key`` is
    unique; blank and null texts add nothing. How many tokens lie before a document comes from running totals over
    (key, number of tokens), so no task sees the whole corpus. A document is cut within its row where its blocks
    end; complete ones stay where they are, and only the up to two incomplete ends of a document are shuffled, to
    meet in their block. The counts are written, as drawing ranges reads them twice.
    """
    docs = df.select(named(key).alias("_doc"), named(text).alias("_text"))
    counts = docs.select(F.col("_doc").alias("_key"), F.regexp_count("_text", F.lit(f"{NOT_SPACE}++")).cast("long").alias("_n"))
    path = scratch_path(df.sparkSession, "counts")
    counts.write.parquet(path)
    totals = running_totals(df.sparkSession.read.parquet(path).filter("_n > 0"), ["_key"], {"_end": F.col("_n")})
    placed = docs.join(totals, F.col("_doc").eqNullSafe(F.col("_key")))
    # A filler token for each token that is in the first block already keeps the grid of blocks.
    before = F.col("_end") - F.col("_n")
    filled = F.concat(F.repeat(F.lit("x "), (before % size).cast("int")), "_text")
    run = f"(?:{NOT_SPACE}++{SPACE}*+){{1,{size}}}"
    rows = placed.select(before.alias("_before"), filled.alias("_filled"))
    runs = rows_of(rows, "_before", F.regexp_extract_all("_filled", F.lit(run), F.lit(0)), item="_run", position="_at")
    first = F.when(F.col("_at") == 0, F.col("_before") % size).otherwise(0).cast("int")
    block = F.floor(F.col("_before") / F.lit(size)).cast("long") + F.col("_at")
    cut = runs.select(F.struct("_before", block.alias("block")).alias("_place"), first.alias("_first"), tokens_of(F.col("_run")).alias("_all"))
    # Exploded from an array of one, or the filters on sizes would cut every run a second time.
    own = F.array(F.slice("_all", F.col("_first") + 1, F.size("_all") - F.col("_first")))
    pieces = rows_of(cut, "_place", own, item="tokens").select("_place.*", "tokens")
    whole = pieces.filter(F.size("tokens") == size).select("block", "tokens")
    ends = pieces.filter(F.size("tokens") < size).groupBy("block").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("_before", "tokens"))), lambda p: p["tokens"])).alias("tokens")
    )
    n = F.size("tokens")
    return whole.unionByName(ends).select("block", "tokens", n.alias("n_tokens"), (n == size).alias("complete"))


def pad_tokens(tokens: Column, size: int = BLOCK, filler: str = "") -> Column:
    """Exactly ``size`` tokens: cut, or filled up at the end."""
    missing = F.greatest(F.lit(size) - F.size(tokens), F.lit(0))
    return F.concat(F.slice(tokens, 1, size), F.array_repeat(F.lit(filler), missing))


def prompt_dataset(df: DataFrame, prompt: str, completion: str) -> DataFrame:
    """Prompt and completion, lower-cased and stripped; rows with a blank side are dropped."""
    tidy = df.select(
        strip(F.lower(named(prompt))).alias("prompt"), strip(F.lower(named(completion))).alias("completion")
    )
    return tidy.filter("prompt <> '' AND completion <> ''")


def next_turn(turns: DataFrame, group: str, position: str, role: str, asks: str, answers: str, text: str) -> DataFrame:
    """Each turn of ``asks`` with the turn of ``answers`` that directly follows it.

    An equi join on group and position: a conversation of any length spreads over the partitions,
    which a lead() window per conversation would not allow.
    """
    first = turns.filter(named(role) == asks).select(
        named(group), named(position), named(text).alias("prompt")
    )
    reply = turns.filter(named(role) == answers).select(
        named(group), (named(position) - 1).alias(position), named(text).alias("completion")
    )
    return first.join(reply, [group, position])
