"""Quotation linking: conversations in reply order, without the passages they quote.

A message's lines are cut into quote levels (how many `>` stand before them) and its own text.
Quoted passages are normalised (case, white space, punctuation) and hashed, line by line and as whole
paragraphs; so are the own words of every message. A passage's original is the first message of
the conversation whose own words have its hash; a message's parent is the earlier message from which
most of its first-level quotes come (by characters; the latest of equals). Deeper levels are
counted and left out of the text, as they quote what the parent quotes.

Own words are summed to one row a conversation and hash before the join, so a passage that every message has
is one row; AQE can split the quoting side. Threads come from pointer doubling over the links, whose
rounds grow with the logarithm of the longest reply chain. Places come from sampled splitters, so that a conversation
with a third of all messages is no single task's.

Defined results: null and blank messages have no words and quote nothing; a quote without an original links nothing; messages without
a parent start threads; repeated rows share their parent and each have a place; messages with a null turn come last and are never parents;
a null conversation is one of its own; of parents with as many quoted characters the latest counts; a very long message is parsed whole, alone in its chunk; an empty table gives an
empty result. Only the four named columns are read, so other columns may have any name.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.llm.common import discard, map_texts, ship, stored
from loomframe.llm.sharding import placed

ship(__name__)

LEVEL = re.compile(r"^[ \t]{0,3}((?:>[ \t]?)+)")
INTRO = re.compile(r"^\s*(?:on\b.{0,300}\bwrote|am\b.{0,300}\bschrieb.{0,100}|le\b.{0,300}\ba écrit|el\b.{0,300}\bescribió)\s*:\s*$|^\s*-{3,}\s*original message\s*-{3,}\s*$", re.I)
NOT_WORD = re.compile(r"[\W_]+")
NEVER = (1 << 63) - 1


def normal(line: str) -> str:
    return NOT_WORD.sub(" ", line).strip().casefold()


def parse(text: str | None) -> tuple[str, int, list[tuple[int, int, int]]]:
    """(own text, deepest level, passages as (level, hash, characters)); level 0 is the message's own words.

    The line before a quote that only says who wrote it is left out of the own text.
    """
    own: list[str] = []
    passages: dict = {}
    deepest = 0
    paragraph: list[str] = []
    at = 0

    def passage(level: int, s: str) -> None:
        h = xxhash.xxh64_intdigest(s.encode("utf-8", "replace")) - (1 << 63)
        passages[level, h] = len(s)

    def close() -> None:
        if len(paragraph) > 1:
            passage(at, " ".join(paragraph))
        paragraph.clear()

    for line in (text or "").split("\n"):
        m = LEVEL.match(line)
        level = m[1].count(">") if m else 0
        body = line[m.end() :] if m else line
        if level != at:
            close()
            if level > at == 0:
                while own and not own[-1].strip():
                    own.pop()
                if own and INTRO.match(own[-1]):
                    own.pop()
            at = level
        deepest = max(deepest, level)
        s = normal(body)
        if s:
            passage(level, s)
            paragraph.append(s)
        else:
            close()
        if level == 0:
            own.append(line.rstrip("\r"))
    close()
    return "\n".join(own).strip("\n"), deepest, [(k[0], k[1], n) for k, n in passages.items()]


PARSED = T.StructType([
    T.StructField("own", T.StringType()),
    T.StructField("levels", T.IntegerType()),
    T.StructField("passages", T.ArrayType(T.StructType([T.StructField("level", T.IntegerType()), T.StructField("hash", T.LongType()), T.StructField("chars", T.LongType())]))),
])


def parsed(messages: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """(keep..., own, levels, passages) of each message."""
    kind = pa.list_(pa.struct([("level", pa.int32()), ("hash", pa.int64()), ("chars", pa.int64())]))

    def run(texts):
        got = [parse(None if t is None else t.decode("utf-8", "replace")) for t in texts]
        rows = [[{"level": a, "hash": b, "chars": c} for a, b, c in g[2]] for g in got]
        return {"own": pa.array([g[0] for g in got], pa.string()), "levels": pa.array([g[1] for g in got], pa.int32()), "passages": pa.array(rows, kind)}

    return map_texts(messages, text, keep, run, PARSED)


def roots(links: DataFrame) -> DataFrame:
    """(c, t, root, depth) of every message (c, t) with a parent (c, t, up), by pointer doubling. up < t, so there are no cycles."""
    e = stored(links.select("c", "t", F.col("up").alias("root"), F.lit(1).cast("long").alias("depth")), "links")
    while True:
        step = e.select("c", F.col("t").alias("root"), F.col("root").alias("far"), F.col("depth").alias("more"))
        before, e = e, stored(e.join(step, ["c", "root"], "left").select("c", "t", F.coalesce("far", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("far").isNotNull().alias("moved")), "links")
        discard(before)
        if not e.where("moved").limit(1).count():
            return e.drop("moved")


def conversations(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, reply_to, root, depth, place, levels, quoted, linked, text) of each message.

    reply_to: the parent's turn; root, depth: the turn that starts the message's thread and its distance. place: rank in
    the conversation by (root, turn), from 0: replies stand after what they reply to. levels: deepest quote;
    quoted, linked: quoted passages and those with an original; text: own words only. conv and turn are integers.
    """
    all_ = stored(parsed(messages, text, [conv, turn, role]).toDF("conv", "turn", "role", "own", "levels", "passages"), "messages")
    keyed = all_.withColumns({"c": F.coalesce(F.col("conv").cast("long"), F.lit(-NEVER)), "t": F.coalesce(F.col("turn").cast("long"), F.lit(NEVER))})
    each = keyed.select("c", "t", F.explode("passages").alias("p")).select("c", "t", "p.level", "p.hash", "p.chars")
    first = each.where(f"level = 0 and t < {NEVER}").groupBy("c", "hash").agg(F.min("t").alias("from"))
    quoted = each.where("level > 0").distinct()
    found = stored(quoted.join(first, ["c", "hash"], "left").select("c", "t", "level", "chars", F.when(F.col("from") < F.col("t"), F.col("from")).alias("from")), "quotes")
    counts = found.groupBy("c", "t").agg(F.count(F.lit(1)).alias("quoted"), F.count("from").alias("linked"))
    by_source = found.where("level = 1 and from is not null").groupBy("c", "t", "from").agg(F.sum("chars").alias("n"))
    links = by_source.groupBy("c", "t").agg(F.max_by("from", F.struct("n", "from")).alias("up"))
    links = stored(links, "parents")
    tree = roots(links).join(links, ["c", "t"])
    info = counts.join(tree, ["c", "t"], "left")
    # rows of messages that quote; the others have none
    out = keyed.select("conv", "turn", "role", "own", "levels", "c", "t").join(info, ["c", "t"], "left")
    out = out.withColumns({"quoted": F.coalesce("quoted", F.lit(0)), "linked": F.coalesce("linked", F.lit(0)), "depth": F.coalesce("depth", F.lit(0)), "root": F.coalesce("root", "t")})
    # h, i, r: places in the order (conversation, root, turn); each row counts as 1
    out = stored(out.withColumns({"h": F.col("c"), "i": F.col("root"), "r": F.col("t"), "size": F.lit(1).cast("long")}), "replies")
    discard(all_, found, links)
    ranked = stored(placed(out.select("h", "i", "r", "size", *[c for c in out.columns if c not in ("h", "i", "r", "size")]))[0], "ranked")
    discard(out)
    start = ranked.groupBy("h").agg(F.min("place").alias("start"))
    out = ranked.join(start, "h")
    return out.select("conv", "turn", "role", F.when(F.col("up").isNotNull(), F.col("up")).alias("reply_to"), F.when(F.col("root") < NEVER, F.col("root")).alias("root"), "depth", (F.col("place") - F.col("start")).alias("place"), "levels", "quoted", "linked", F.col("own").alias("text"))


def op2_quotation_linking(spark, sf_dir: str) -> DataFrame:
    return conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet")).withColumnRenamed("conv", "conv_id")
