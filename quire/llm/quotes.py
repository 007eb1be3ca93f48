"""Quotation linking: conversations without quotes, in the order of replies.

A line's quote level is the number of leading > marks. A passage is a run of
lines of one level; what a message says itself is level 0. Passages are compared
by their words (lower case, letters and digits only), so neither wrapping nor
marks matter. Pieces of a passage are hashed: the units in it (the whole
passage, its paragraphs, lines and sentences) and each WINDOW words in a row.
The own passages of all messages offer their pieces; a quoted passage asks for
its own among the earlier messages of the conversation, and each piece is
answered by the latest that offers it. A passage is linked with a message whose
answers cover half of its words or more. The parent of a message is, of the
messages linked with passages of its lowest level that has any, the one that
covers most words, the latest on ties; a message without links follows the one
before it. Messages are then put in reply order: each after its parent, siblings
by turn.

Every piece asked has one answer, however many messages offer it, so a common
line gives no more rows than were asked. Pieces meet by (conversation, hash,
stretch of turns): what earlier stretches offer comes in as one row for each, so
neither a common line nor a hot conversation is one task's work. The walk of a
conversation runs in one task up to `most` messages, on numbers without texts;
the order of a longer one comes from pointer jumping along the tour of its tree.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

#: Words in a row of which each stretch of a passage is a piece.
WINDOW = 5
#: Turns of a conversation in which pieces are looked up by one task.
STRETCH = 1024
#: Messages of a conversation that one task walks.
MOST = 100_000
#: Conversations with quotes whose numbers may be broadcast: 8 bytes each.
FEW = 1_000_000
# A quote mark at the start of a line, with spaces around and between.
_MARKS = re.compile(r"[ \t]*((?:>[ \t]*)+)")
# Lines that introduce a quote and belong to it: "On <date>, <name> wrote:".
_INTRO = r"(?i)^\s*(on\b.*\bwrote|am\b.*\bschrieb.*|le\b.*\ba écrit|el\b.*\bescribió)\s*:\s*$"
_INTRO_LINE = re.compile(_INTRO)
_WORD = re.compile(r"[^\W_]+|[.!?…]+(?=\s|$)|\n")


def passages(text: str) -> list[tuple[int, str]]:
    """(level, text) of the runs of lines of one level, in order; lines that introduce a quote are left out."""
    lines = re.split(r"\r\n?|\n", text)
    out: list[tuple[int, list[str]]] = []
    marks = [_MARKS.match(line) for line in lines]
    for k, (line, mark) in enumerate(zip(lines, marks, strict=True)):
        level = mark[1].count(">") if mark else 0
        if not level and k + 1 < len(lines) and marks[k + 1] and _INTRO_LINE.match(line):
            continue
        if not out or out[-1][0] != level:
            out.append((level, []))
        out[-1][1].append(line[mark.end() :] if mark else line)
    return [(level, "\n".join(rows)) for level, rows in out]


def pieces(passage: str) -> tuple[list[str], list[tuple[int, int, int]]]:
    """The words of a passage, and its pieces (kind, first word, words), each once: 1 for units, 0 for windows."""
    words: list[str] = []
    cuts = {"line": [0], "sentence": [0], "paragraph": [0]}
    breaks = 0
    for m in _WORD.finditer(passage.lower()):
        t = m[0]
        if t == "\n":
            breaks += 1
            cuts["line"].append(len(words))
            if breaks > 1:
                cuts["paragraph"].append(len(words))
                cuts["sentence"].append(len(words))
        elif t[0] in ".!?…":
            cuts["sentence"].append(len(words))
            breaks = 0
        else:
            words.append(t)
            breaks = 0
    n = len(words)
    spans = {(0, n)}
    for c in cuts.values():
        spans.update(zip(c, [*c[1:], n], strict=True))
    found = [(1, a, b - a) for a, b in sorted(spans) if b > a]
    found += [(0, i, WINDOW) for i in range(n - WINDOW + 1)]
    return words, found


def _hash(kind: int, words: list[str]) -> int:
    h = xxhash.xxh64_intdigest(" ".join(words), kind)
    return h - (1 << 64) if h >> 63 else h


_PIECES = "key long, conv_id long, turn long, level int, passage int, words int, at int, n int, hash long"
_PIECES_ARROW = pa.schema([("key", pa.int64()), ("conv_id", pa.int64()), ("turn", pa.int64()), ("level", pa.int32()), ("passage", pa.int32()), ("words", pa.int32()), ("at", pa.int32()), ("n", pa.int32()), ("hash", pa.int64())])


def _to_pieces(batches):
    rows: list[tuple] = []
    for b in batches:
        for key, conv, turn, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            for k, (level, body) in enumerate(passages(text)):
                words, found = pieces(body)
                if level and not found:
                    rows.append((key, conv, turn, level, k, 0, 0, 0, None))
                for kind, at, n in found:
                    rows.append((key, conv, turn, level, k, len(words), at, n, _hash(kind, words[at : at + n])))
                    if len(rows) >= 50_000:
                        yield _batch(rows, _PIECES_ARROW)
                        rows = []
    if rows:
        yield _batch(rows, _PIECES_ARROW)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def answers(offers: DataFrame, asks: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """asks(conv_id, hash, turn, ...) with from_turn and from_key: the latest of offers(conv_id, hash, turn, key) before each; unanswered ones are left out."""
    place = F.floor(F.col("turn") / stretch).alias("stretch")
    offers = offers.groupBy("conv_id", "hash", "turn").agg(F.max("key").alias("key")).withColumn("stretch", place)
    asked = asks.select("conv_id", "hash", "turn").distinct().withColumn("stretch", place)
    both = offers.select("conv_id", "hash", "stretch", "turn", F.lit(1).alias("kind"), F.struct("turn", "key").alias("o")).unionAll(asked.select("conv_id", "hash", "stretch", "turn", F.lit(0), F.lit(None).cast("struct<turn:bigint,key:bigint>")))
    near = Window.partitionBy("conv_id", "hash", "stretch").orderBy("turn", "kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("o", F.last("o", ignorenulls=True).over(near)).where("kind = 0").drop("kind")
    # what the stretches before it offer, one row for each of them
    last = offers.groupBy("conv_id", "hash", "stretch").agg(F.max(F.struct("turn", "key")).alias("o"))
    wanted = asked.select("conv_id", "hash", "stretch").distinct()
    steps = last.select("conv_id", "hash", "stretch", F.lit(1).alias("kind"), "o").unionAll(wanted.select("conv_id", "hash", "stretch", F.lit(0), F.lit(None).cast("struct<turn:bigint,key:bigint>")))
    far = Window.partitionBy("conv_id", "hash").orderBy("stretch", "kind").rowsBetween(Window.unboundedPreceding, 0)
    before = steps.withColumn("before", F.last("o", ignorenulls=True).over(far)).where("kind = 0").select("conv_id", "hash", "stretch", "before")
    found = seen.join(before, ["conv_id", "hash", "stretch"]).select("conv_id", "hash", "turn", F.coalesce("o", "before").alias("o")).where("o is not null")
    return asks.join(found, ["conv_id", "hash", "turn"]).withColumn("from_turn", F.col("o.turn")).withColumn("from_key", F.col("o.key")).drop("o")


def linked(turns: DataFrame, scratch: Scratch, stretch: int = STRETCH) -> tuple[DataFrame, DataFrame]:
    """Links (key, level, passage, from_key, from_turn, n_words) of quoted passages, and (key, parent, n_quoted, n_linked) of the messages that quote; from turns(key, conv_id, turn, text)."""
    quotes = F.col("text").rlike(r"(?m)^[ \t]*>")
    talks = scratch.write(turns.where(quotes & F.col("conv_id").isNotNull()).select("conv_id").distinct(), "quoting")
    few = talks.count() <= FEW
    # a message offers what it says itself if its conversation quotes at all
    concerned = turns.where("conv_id is not null").join(F.broadcast(talks) if few else talks, "conv_id", "left_semi")
    made = scratch.write(concerned.select("key", "conv_id", "turn", "text").mapInArrow(_to_pieces, _PIECES), "pieces")
    offers = made.where("level = 0 and turn is not null").select("conv_id", "hash", "turn", "key")
    asks = made.where("level > 0 and turn is not null and hash is not null")
    hits = answers(offers, asks, stretch)
    # words covered: of each piece, those beyond the ones before it
    passage = ["key", "level", "passage", "from_key", "from_turn"]
    before = Window.partitionBy(*passage).orderBy("at", "n").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("at") + F.col("n")
    new = F.greatest(end - F.greatest(F.coalesce(F.max(end).over(before), F.lit(0)), "at"), F.lit(0))
    links = hits.withColumn("new", new).groupBy(*passage).agg(F.sum("new").cast("int").alias("n_words"), F.first("words").alias("words")).where("n_words * 2 >= words").drop("words")
    links = scratch.write(links, "links")
    votes = links.groupBy("key", "level", "from_turn", "from_key").agg(F.sum("n_words").alias("n"))
    best = votes.groupBy("key").agg(F.max(F.struct((-F.col("level")).alias("nearest"), "n", "from_turn", "from_key")).alias("b"))
    quoted = made.where("level > 0").groupBy("key").agg(F.count_distinct("passage").alias("n_quoted"))
    answered = links.groupBy("key").agg(F.count_distinct("passage").alias("n_linked"))
    return links, quoted.join(best, "key", "left").join(answered, "key", "left").select("key", F.col("b.from_key").alias("parent"), "n_quoted", F.coalesce("n_linked", F.lit(0)).alias("n_linked"))


# ---------------------------------------------------------------- reply order

_ORDER = "key long, reply_to long, position long, depth long"
_ORDER_ARROW = pa.schema([("key", pa.int64()), ("reply_to", pa.int64()), ("position", pa.int64()), ("depth", pa.int64())])


def _walk(batches):
    """Reply order of conversations that come one after the other, each by turn: (key, conv_id, turn, parent) to (key, reply_to, position, depth)."""
    held: list[tuple] = []
    out: list[tuple] = []
    talk = None
    for b in batches:
        for key, conv, turn, parent in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if conv != talk and held:
                out += _tree(held)
                held = []
                if len(out) > 50_000:
                    yield _batch(out, _ORDER_ARROW)
                    out = []
            talk = conv
            held.append((key, turn, parent))
    out += _tree(held)
    if out:
        yield _batch(out, _ORDER_ARROW)


def _tree(rows: list[tuple]) -> list[tuple]:
    turn_of = {key: turn for key, turn, _ in rows}
    kids: dict = {}
    before = None
    for key, _, parent in rows:
        kids.setdefault(before if parent is None else parent, []).append(key)
        before = key
    out, stack = [], [(k, None, 0) for k in reversed(kids.get(None, []))]
    while stack:
        k, parent, depth = stack.pop()
        out.append((k, turn_of.get(parent), len(out), depth))
        stack.extend((c, k, depth + 1) for c in reversed(kids.get(k, [])))
    return out


def _numbered(rows: DataFrame, order: list, name: str, scratch: Scratch) -> DataFrame:
    """rows with `name`, their place from 0 in a global order; no partition has to be whole."""
    sorted_ = scratch.write(rows.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33)), f"sorted-{name}")
    sizes = sorted_.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each partition of the sort
    start = sizes.withColumn("_start", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")
    return sorted_.join(F.broadcast(start), "_part").withColumn(name, F.col("_start") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id", "_part", "_start")


def long_order(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """What _walk gives of rows(key, conv_id, turn, parent), without a conversation ever being in one task.

    The tour of a tree enters and leaves each message; the entries and exits left
    to the end of the tour, which doubling the steps adds up, give place and depth.
    """
    at = scratch.write(_numbered(rows, [F.col("conv_id"), F.col("turn").asc_nulls_last(), F.col("key")], "idx", scratch), "numbered")
    ahead = at.select((F.col("idx") + 1).alias("idx"), F.col("conv_id").alias("c"), F.col("idx").alias("prev"))
    named = at.select(F.col("key").alias("parent"), F.col("idx").alias("named"))
    up = at.join(ahead, "idx", "left").join(named, "parent", "left")
    up = scratch.write(up.select("idx", "key", "conv_id", "turn", F.coalesce("named", F.when(F.col("c") == F.col("conv_id"), F.col("prev"))).alias("up")), "up")
    kids = scratch.write(_numbered(up.where("up is not null").select("up", "idx"), ["up", "idx"], "j", scratch), "kids")
    later = kids.select((F.col("j") - 1).alias("j"), F.col("up").alias("u"), F.col("idx").alias("later"))
    sibling = kids.join(later, "j").where("up = u").select("idx", "later")
    first = kids.groupBy(F.col("up").alias("idx")).agg(F.min("idx").alias("child"))
    tree = up.join(first, "idx", "left").join(sibling, "idx", "left")
    # element 2 * idx enters a message, 2 * idx + 1 leaves it
    enter = tree.select((F.col("idx") * 2).alias("e"), F.coalesce(F.col("child") * 2, F.col("idx") * 2 + 1).alias("next"), F.lit(1).cast("long").alias("enters"), F.lit(1).cast("long").alias("balance"))
    leave = tree.select((F.col("idx") * 2 + 1).alias("e"), F.coalesce(F.col("later") * 2, F.col("up") * 2 + 1).alias("next"), F.lit(0).cast("long").alias("enters"), F.lit(-1).cast("long").alias("balance"))
    cur, step = scratch.write(enter.unionAll(leave), "tour0"), 0
    while not cur.where("next is not null").isEmpty():
        other = cur.select(F.col("e").alias("next"), F.col("next").alias("then"), F.col("enters").alias("more"), F.col("balance").alias("shift"))
        done = cur.where("next is null")
        went = cur.where("next is not null").join(other, "next").select("e", F.col("then").alias("next"), (F.col("enters") + F.col("more")).alias("enters"), (F.col("balance") + F.col("shift")).alias("balance"))
        nxt = scratch.write(done.unionAll(went), f"tour{step + 1}")
        scratch.drop(f"tour{step}")
        cur, step = nxt, step + 1
    sizes = up.groupBy("conv_id").agg(F.count("*").alias("n"))
    turn_of = up.select(F.col("idx").alias("up"), F.col("turn").alias("reply_to"))
    ends = cur.select((F.col("e") / 2).cast("long").alias("idx"), "enters", "balance").where("e % 2 = 0")
    found = up.join(ends, "idx").join(turn_of, "up", "left").join(F.broadcast(sizes), "conv_id")  # MOST messages or more for each size
    return found.select("key", "reply_to", (F.col("n") - F.col("enters")).alias("position"), (-F.col("balance")).alias("depth"))


def reply_order(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", most: int = MOST, stretch: int = STRETCH) -> DataFrame:
    """(conv_id, turn, role, text, reply_to, position, depth, n_quoted, n_linked): a row for each message.

    text has no quoted lines, no line that introduces a quote, and no blank ends;
    reply_to is the parent's turn (null for the first message); n_quoted counts
    the quoted passages, n_linked those of them that are linked. A null text is
    empty. Messages with a null turn come last and are not linked; one with a null
    conv_id is a conversation of its own. Rows that repeat (conv_id, turn) are
    messages of their own, none earlier than the other. Other columns are
    ignored, whatever their names. An empty table gives no rows.
    """
    spark: SparkSession = conversations.sparkSession
    scratch = Scratch(spark, "quotes")
    rows = conversations.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    turns = scratch.write(rows.withColumn("key", F.monotonically_increasing_id()), "turns")
    _, links = linked(turns, scratch, stretch)
    links = scratch.write(links, "messages")
    numbers = turns.where("conv_id is not null").select("key", "conv_id", "turn").join(links.select("key", "parent"), "key", "left")
    hot = scratch.write(turns.where("conv_id is not null").groupBy("conv_id").count().where(F.col("count") > most).select("conv_id"), "hot")
    n_hot = hot.count()
    if n_hot:
        small = F.broadcast(hot) if n_hot <= FEW else hot
        order = long_order(numbers.join(small, "conv_id", "left_semi"), scratch)
        numbers = numbers.join(small, "conv_id", "left_anti")
    by_turn = numbers.select("key", "conv_id", "turn", "parent").repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "key")
    walked = by_turn.mapInArrow(_walk, _ORDER)
    order = scratch.write(walked.unionAll(order) if n_hot else walked, "order")
    lines = F.split(F.regexp_replace("text", r"\r\n?", "\n"), "\n")
    quoted = lambda line: F.coalesce(line.rlike(r"^[ \t]*>"), F.lit(False))
    said = F.filter(lines, lambda line, i: ~quoted(line) & ~(line.rlike(_INTRO) & quoted(F.get(lines, i + 1))))
    clean = F.when(F.col("text").rlike(r"(?m)^[ \t]*>"), F.array_join(said, "\n")).otherwise(F.col("text"))
    clean = F.regexp_replace(clean, r"^\s+|\s+$", "")
    texts = turns.select("key", "conv_id", "turn", "role", clean.alias("text"))
    out = texts.join(order, "key", "left").join(links.select("key", "n_quoted", "n_linked"), "key", "left")
    zero = F.lit(0).cast("long")
    return out.select("conv_id", "turn", "role", "text", "reply_to", F.coalesce("position", zero).alias("position"), F.coalesce("depth", zero).alias("depth"), F.coalesce("n_quoted", zero).alias("n_quoted"), F.coalesce("n_linked", zero).alias("n_linked"))


def op10_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations in reply order, without quotes."""
    return reply_order(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
