"""Chat formatting: recover the turns of a plain transcript and render them in one form.

A transcript is a list of lines. Each line has a few features (the speaker marker it starts with, a blank line before it,
a closing question mark, its length, a list mark). A hidden Markov model has two states for each role, a turn's first line
and its further lines; its start, transition and feature probabilities are smoothed counts over labelled transcripts, and
Viterbi gives the likeliest states of a transcript. Turns are then rendered canonically, without their markers.

A conversation may be longer than one task should hold, so it is parsed in blocks of turns. Each block of a conversation
that has several tells the best score from every first to every last state; these small tables are chained in order, and
each block is then decoded between the states that the likeliest path of the whole conversation has at its borders. The
blocks' renderings, one after another, are the whole conversation's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillbank.llm.shared import cut, fold_remainder, read, ship

ROLES = ("system", "user", "assistant")
STATES = 2 * len(ROLES)  # role * 2: first line, role * 2 + 1: further line
#: Names that introduce a speaker, by role. Fixed values.
NAMES = {
    "system": ("system", "instruction", "instructions", "context"),
    "user": ("user", "human", "customer", "question", "q"),
    "assistant": ("assistant", "ai", "bot", "answer", "a"),
}
ROLE_OF = {name: k for k, role in enumerate(ROLES) for name in NAMES[role]}
#: "Name:", "**Name:**", "[Name]", "### Name", "<|name|>" at the start of a line.
MARKER = regex.compile(r"^[ \t]*(?:[*_]{0,2}(?P<n>[A-Za-z]+)[*_]{0,2}[ \t]*:[*_]{0,2}|\[(?P<n>[A-Za-z]+)\]:?|#{1,4}[ \t]*(?P<n>[A-Za-z]+)[ \t]*(?::|$)|<\|?(?P<n>[A-Za-z]+)\|?>)[ \t]*")
LISTED = regex.compile(r"^[ \t]*(?:[-*•]|\d+[.)])[ \t]")
#: Values of each feature.
SIZES = (len(ROLES) + 1, 2, 2, 4, 2)
#: Turns that are parsed together.
BLOCK_TURNS = 256
SMOOTH = 0.5


def marker(line: str) -> tuple[int, int]:
    """The role that a line's marker names (or -1) and where the text after it begins."""
    m = MARKER.match(line)
    role = ROLE_OF.get(m["n"].lower(), -1) if m else -1
    return (role, m.end()) if role >= 0 else (-1, 0)


def line_features(lines: list[str]) -> np.ndarray:
    """A row for each line that is not blank: its place and its feature values."""
    out, blank = [], 1
    for i, line in enumerate(lines):
        bare = line.strip()
        if not bare:
            blank = 1
            continue
        n = len(bare)
        out.append((i, marker(line)[0] + 1, blank, int(bare.endswith("?")), 0 if n < 20 else 1 if n < 60 else 2 if n < 140 else 3, int(bool(LISTED.match(line)))))
        blank = 0
    return np.array(out, np.int64).reshape(-1, 1 + len(SIZES))


class Model:
    """Log probabilities from counts: ``start`` by state, ``moves`` by pair of states, ``seen`` by state and feature value."""

    def __init__(self, start: np.ndarray, moves: np.ndarray, seen: np.ndarray):
        legal = np.array([[b % 2 == 0 or b // 2 == a // 2 for b in range(STATES)] for a in range(STATES)])  # further lines keep the role
        first = np.arange(STATES) % 2 == 0
        with np.errstate(divide="ignore"):
            self.start = np.log(np.where(first, start + SMOOTH, 0) / (start + SMOOTH)[first].sum())
            moves = np.where(legal, moves + SMOOTH, 0)
            self.moves = np.log(moves / moves.sum(axis=1, keepdims=True))
        self.seen, at = np.zeros((STATES, sum(SIZES))), 0
        for size in SIZES:
            part = seen[:, at : at + size] + SMOOTH
            self.seen[:, at : at + size] = np.log(part / part.sum(axis=1, keepdims=True))
            at += size

    def emissions(self, features: np.ndarray) -> np.ndarray:
        offsets = np.cumsum((0, *SIZES[:-1]))
        return self.seen[:, features + offsets].sum(axis=2).T

    def viterbi(self, features: np.ndarray, first: int | None = None, last: int | None = None) -> list[int]:
        """The likeliest states, of equals the one of least number; ``first`` and ``last`` fix the states at either end."""
        if not len(features):
            return []
        told = self.emissions(features)
        best, back = (self.start if first is None else np.where(np.arange(STATES) == first, 0.0, -np.inf)) + told[0], []
        for row in told[1:]:
            through = best[:, None] + self.moves
            back.append(through.argmax(axis=0))
            best = through.max(axis=0) + row
        path = [int(best.argmax()) if last is None else last]
        for step in reversed(back):
            path.append(int(step[path[-1]]))
        return path[::-1]

    def table(self, features: np.ndarray) -> np.ndarray | None:
        """The best score of any path from each first to each last state, emissions included; None without lines."""
        if not len(features):
            return None
        told = self.emissions(features)
        best = np.where(np.eye(STATES, dtype=bool), told[0][:, None], -np.inf)
        for row in told[1:]:
            best = (best[:, :, None] + self.moves[None]).max(axis=1) + row
        return best

    def chain(self, tables: list[np.ndarray | None]) -> list[tuple[int, int] | None]:
        """For the tables of consecutive blocks the first and last states of the likeliest path through all of them."""
        best, steps = None, []
        for table in tables:
            if table is None:
                steps.append(None)
                continue
            through = None if best is None else best[:, None] + self.moves
            enter = self.start if through is None else through.max(axis=0)
            ways = enter[:, None] + table
            best = ways.max(axis=0)
            steps.append((None if through is None else through.argmax(axis=0), ways.argmax(axis=0)))
        out: list[tuple[int, int] | None] = []
        last = None if best is None else int(best.argmax())
        for step in reversed(steps):
            if step is None:
                out.append(None)
                continue
            first = int(step[1][last])
            out.append((first, last))
            last = None if step[0] is None else int(step[0][first])
        return out[::-1]


def parse(text: str | None, model: Model, first: int | None = None, last: int | None = None, opened: bool = False, inside: bool = False, bare: bool = False) -> list[tuple[str, str]]:
    """(role, text) of each turn. Blank lines inside a turn stay; null, empty and blank transcripts have no turns.

    For a block of a longer transcript: its ``first`` and ``last`` states, and whether its last turn goes on in the next
    block (``opened``), it has only blank lines inside a turn (``inside``), or begins in a turn of which there is no text
    yet (``bare``). A first turn that goes on from the block before has the role "" and all lines from the block's start.
    """
    lines = text.split("\n") if text else []
    rows = line_features(lines)
    if inside and not len(rows):
        return [("", "" if bare else text or "")]
    states = model.viterbi(rows[:, 1:], first, last)
    begins = [k for k, s in enumerate(states) if s % 2 == 0]
    turns = []
    if states and states[0] % 2:
        end = begins[0] if begins else len(rows)
        body = "\n".join(lines[: len(lines) if opened and end == len(rows) else int(rows[end - 1, 0]) + 1])
        body = body.lstrip("\n") if bare else body
        turns.append(("", body if opened and end == len(rows) else body.rstrip("\n")))
    for k, nxt in zip(begins, [*begins, len(rows)][1:], strict=True):
        on = opened and nxt == len(rows)
        lo, hi = int(rows[k, 0]), len(lines) if on else int(rows[nxt - 1, 0]) + 1
        role, cut_at = marker(lines[lo])
        body = "\n".join([lines[lo][cut_at if role >= 0 else 0 :], *lines[lo + 1 : hi]])
        turns.append((ROLES[states[k] // 2], body.lstrip("\n") if on else body.strip("\n")))
    return turns


def _escaped(text: str) -> str:
    """``text`` in which no marker of the rendering can occur: "<|" becomes "<||"."""
    return text.replace("<|", "<||")


def render(turns: list[tuple[str, str]], opened: bool = False) -> str:
    """Turns in one form. A turn without a role goes on from the block before, an ``opened`` one goes on in the next."""
    out = []
    for k, (role, text) in enumerate(turns):
        end = "\n<|end|>\n" if not opened or k + 1 < len(turns) else "\n" if text else ""
        out.append((f"<|{role}|>\n" if role else "") + _escaped(text) + end)
    return "".join(out)


def _labelled(turns: list[dict]) -> tuple[np.ndarray, list[int]]:
    """The features and true states of the lines of some turns (role, shown)."""
    lines, states = [], []
    for t in turns:
        if t["role"] not in ROLES:
            continue
        shown = (t["shown"] or "").split("\n")
        lines += shown
        full = [i for i, x in enumerate(shown) if x.strip()]
        states += [2 * ROLES.index(t["role"]) + (i != full[0]) for i in full]
    return line_features(lines), states


def _count(labelled: DataFrame) -> Model:
    """The model of transcripts given as conv_id, block and ``turns``, arrays of (role, shown): what a turn's lines look like."""
    ship(labelled.sparkSession)
    width = STATES + sum(SIZES)

    def run(batches):
        moves, seen = np.zeros((STATES, STATES), np.int64), np.zeros((STATES, sum(SIZES)), np.int64)
        offsets = np.cumsum((0, *SIZES[:-1]))
        for batch in batches:
            for turns in batch.column("turns").to_pylist():
                rows, states = _labelled(turns or [])
                if len(rows):
                    np.add.at(moves, (states[:-1], states[1:]), 1)
                    np.add.at(seen, (np.array(states)[:, None], rows[:, 1:] + offsets), 1)
        table = np.column_stack([moves, seen])
        yield pa.RecordBatch.from_arrays([pa.array(list(range(STATES)), pa.int32()), *(pa.array(np.ascontiguousarray(table[:, k])) for k in range(width))], names=["state", *(f"c{k}" for k in range(width))])

    def ends(batches):
        for batch in batches:
            states = [_labelled(turns or [])[1] for turns in batch.column("turns").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("block"), pa.array([s[0] if s else None for s in states], pa.int32()), pa.array([s[-1] if s else None for s in states], pa.int32())], names=["conv_id", "block", "head", "tail"])

    columns = [f"c{k}" for k in range(width)]
    summed = labelled.select("turns").mapInArrow(run, "state int, " + ", ".join(f"{c} bigint" for c in columns)).groupBy("state").agg(*[F.sum(c).alias(c) for c in columns])
    table = np.zeros((STATES, 1 + width))
    for r in summed.collect():  # a row for each state
        table[r["state"], 1:] = [r[c] for c in columns]
    kinds = ", ".join(f"{c} {labelled.schema[c].dataType.simpleString()}" for c in ("conv_id", "block"))
    before = F.last("tail", ignorenulls=True).over(Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    borders = labelled.select("conv_id", "block", "turns").mapInArrow(ends, kinds + ", head int, tail int").withColumn("before", before).where("head IS NOT NULL")
    for r in borders.groupBy("before", "head").agg(F.count("*").alias("n")).collect():  # a row for each pair of states
        table[r["head"] if r["before"] is None else r["before"], 0 if r["before"] is None else 1 + r["head"]] += r["n"]
    return Model(table[:, 0], table[:, 1 : 1 + STATES], table[:, 1 + STATES :])


BORDER = "first int, last int, opened boolean, inside boolean, bare boolean"


def _borders(blocks: DataFrame, model: Model) -> DataFrame:
    """conv_id, block and BORDER for the blocks of conversations that have several."""
    held = blocks.sparkSession.sparkContext.broadcast(model)
    several = blocks.groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 1").select("conv_id")
    kinds = "".join(f"{c} {blocks.schema[c].dataType.simpleString()}, " for c in ("conv_id", "block"))

    def tables(batches):
        for batch in batches:
            lines = [t.split("\n") if t else [] for t in batch.column("transcript").to_pylist()]
            made = [held.value.table(line_features(x)[:, 1:]) for x in lines]
            ends = [next((line for line in reversed(x) if line.strip()), "") for x in lines]
            marked = [marker(line) for line in ends]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("block"), pa.array([None if m is None else m.ravel().tolist() for m in made], pa.list_(pa.float64())), pa.array([role >= 0 and not line[at:] for line, (role, at) in zip(ends, marked, strict=True)], pa.bool_())], names=["conv_id", "block", "best", "marked"])

    def chained(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        path = held.value.chain([None if x is None else np.array(x).reshape(STATES, STATES) for x in table.column("best").to_pylist()])
        goes_on, opened = False, []
        for place in reversed(path):  # whether the next block with lines begins inside a turn
            opened.append(goes_on)
            goes_on = goes_on if place is None else bool(place[0] % 2)
        opened.reverse()
        only_marked, bare = False, []  # whether the last turn so far is a marker alone
        for place, mark in zip(path, table.column("marked").to_pylist(), strict=True):
            bare.append(only_marked)
            only_marked = only_marked if place is None else mark and place[1] % 2 == 0
        told = {"first": pa.array([p and p[0] for p in path], pa.int32()), "last": pa.array([p and p[1] for p in path], pa.int32()), "opened": pa.array(opened, pa.bool_()), "inside": pa.array([p is None and o for p, o in zip(path, opened, strict=True)], pa.bool_()), "bare": pa.array(bare, pa.bool_())}
        return pa.table({"conv_id": table.column("conv_id"), "block": table.column("block"), **told})

    long = blocks.select("conv_id", "block", "transcript").join(several.hint("merge"), "conv_id", "left_semi")
    return long.mapInArrow(tables, kinds + "best array<double>, marked boolean").groupBy("conv_id").applyInArrow(chained, kinds + BORDER)


def format_chats(transcripts: DataFrame, model: Model) -> DataFrame:
    """``transcripts`` (conv_id, block, transcript ...) with ``turns`` (role, text) and ``rendered`` instead of ``transcript``.

    Blocks of one conv_id are parsed as one transcript: their ``rendered``, in the order of ``block``, make up the
    whole. The turn of an empty role goes on from the block before.
    """
    ship(transcripts.sparkSession)
    held = transcripts.sparkSession.sparkContext.broadcast(model)
    border = [x.split()[0] for x in BORDER.split(", ")]
    others = [c for c in transcripts.columns if c not in ("transcript", "turns", "rendered", *border)]
    told = transcripts.select(*others, "transcript").join(cut(_borders(transcripts, model)).hint("merge"), ["conv_id", "block"], "left").select(*others, "transcript", *border)

    def run(batches):
        for batch in batches:
            places = [(a, b, bool(c), bool(d), bool(e)) for a, b, c, d, e in zip(*(batch.column(c).to_pylist() for c in border), strict=True)]
            found = [parse(t, held.value, *place) for t, place in zip(batch.column("transcript").to_pylist(), places, strict=True)]
            shown = [render(f, place[2]) for f, place in zip(found, places, strict=True)]
            turns = pa.array([[{"role": r, "text": x} for r, x in f] for f in found], pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in others] + [turns, pa.array(shown, pa.string())], names=[*others, "turns", "rendered"])

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in transcripts.schema if f.name in others)
    return told.mapInArrow(run, kept + "turns array<struct<role:string,text:string>>, rendered string")


#: How the transcripts of the query show their speakers, by a hash of the conversation: before the text, by role.
STYLES = (
    {"system": "System: ", "user": "User: ", "assistant": "Assistant: "},
    {"system": "[Instructions] ", "user": "[Human] ", "assistant": "[AI] "},
    {"system": "### Context\n", "user": "### Question\n", "assistant": "### Answer\n"},
    {"system": "<|system|>\n", "user": "<|user|>\n", "assistant": "<|assistant|>\n"},
    {"system": "", "user": "", "assistant": ""},
)


def transcripts(conversations: DataFrame) -> DataFrame:
    """conv_id, block, turns (role, text, shown) in order and transcript, one row for each block of a conversation.

    Exact repeats of a row count once; rows without conv_id, turn or a known role are no part of a transcript; a null
    text is an empty one. Blocks bound what one row holds.
    """
    rows = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull() & F.col("role").isin(*ROLES)).distinct()
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES)))
    before = F.coalesce(*[F.when((style == k) & (F.col("role") == role), F.lit(mark)) for k, s in enumerate(STYLES) for role, mark in s.items()])
    rows = rows.withColumn("shown", F.concat(before, "text", F.lit("\n")))
    grouped = rows.groupBy("conv_id", F.expr(f"turn DIV {BLOCK_TURNS}").alias("block")).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "shown"))).alias("turns"))
    return grouped.withColumn("transcript", F.concat_ws("\n", F.transform("turns", lambda t: t["shown"])))


def train(blocks: DataFrame, train_rows: Column) -> Model:
    """The model of the rows where ``train_rows``, a condition on conv_id, holds."""
    return _count(blocks.where(train_rows).select("conv_id", "block", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), F.concat(t["shown"], F.lit("\n")).alias("shown"))).alias("turns")))


def op6(spark, sf_dir: str) -> DataFrame:
    """A row for each block: its turns, those found, those of them with the right role at the right place, and the rendering's digest."""
    blocks = transcripts(read(spark, sf_dir, "conversations"))
    model = train(blocks, fold_remainder(F.col("conv_id"), 4) != 2)
    parsed = format_chats(blocks.select("conv_id", "block", F.transform("turns", lambda t: t["role"]).alias("true_roles"), "transcript"), model)
    parsed = parsed.withColumn("turns", F.filter("turns", lambda t: t["role"] != ""))  # those that begin in the block
    right = F.size(F.filter(F.arrays_zip(F.col("true_roles").alias("a"), F.transform("turns", lambda t: t["role"]).alias("b")), lambda x: x["a"] == x["b"]))
    return parsed.select(
        "conv_id", F.col("block").cast("long").alias("block"), (fold_remainder(F.col("conv_id"), 4) == 2).alias("held_out"), F.size("true_roles").cast("long").alias("n_turns"),
        F.size("turns").cast("long").alias("n_found"), right.cast("long").alias("n_right"), F.concat_ws(",", F.transform("turns", lambda t: t["role"])).alias("roles"), F.sha2("rendered", 256).alias("rendered_sha256"),
    )
