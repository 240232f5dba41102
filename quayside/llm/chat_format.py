"""Chat formatting: records of any known layout become turns, and turns become one marked-up text for each conversation.

Layouts. A record is a JSON object. Its fingerprint is a hash of the sorted set of its nested field paths (`messages[].role`), whatever the values. The first
record of a fingerprint in a worker looks for the declared layout whose needed paths are all there (the one that names most
paths wins, then the first declared); every other record of that fingerprint takes its mapping from the table. A mapping says only which paths hold role and text.

Output. A turn is `### role: text</turn>` and a line feed. Inside texts and roles a backslash becomes `\\\\`, `###` becomes `\\h`, `</turn>` becomes `\\e`, and in roles `:` becomes
`\\c`; so no control string is ever left in a text, and the change can be undone. Formatted text is written in pieces of about PIECE characters, in the order of conversations and
turns, with the spans that a loss counts (the texts of assistants) beside it. A conversation may have many pieces and stand in many tasks' files.

Cases: null text is empty; a null role is empty; a null conv_id is a conversation of its own; equal turns are ordered by place in the record, role, then a hash of the text;
repeated rows are turns each; a record that is no JSON object, or of no known layout, is returned by unmapped() and never formatted; an empty table gives no rows; a very long text makes one
long piece; a conversation of any length is read back piece by piece; columns other than those named are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import stored

PIECE = 1 << 18
MAPPED = 1 << 12


@dataclass(frozen=True)
class Turn:
    """A turn or, with `each`, a turn for each item of a list: where its role (a path, or `=role`) and its text are."""

    role: str
    text: str
    each: str | None = None


@dataclass(frozen=True)
class Layout:
    """Needed paths, and the turns in order."""

    name: str
    needs: tuple[str, ...]
    turns: tuple[Turn, ...]


#: Spellings of roles that list layouts use: fixed values.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}
LAYOUTS = (
    Layout("messages", ("messages[].role", "messages[].content"), (Turn("role", "content", "messages"),)),
    Layout("message parts", ("messages[].role", "messages[].content[].text"), (Turn("role", "content[].text", "messages"),)),
    Layout("from and value", ("conversations[].from", "conversations[].value"), (Turn("from", "value", "conversations"),)),
    Layout("dialog", ("dialog[].speaker", "dialog[].utterance"), (Turn("speaker", "utterance", "dialog"),)),
    Layout("message", ("message.role", "message.content"), (Turn("message.role", "message.content"),)),
    Layout("row", ("role", "text"), (Turn("role", "text"),)),
    Layout("row without text", ("role",), (Turn("role", "text"),)),
    Layout("row without role", ("text",), (Turn("role", "text"),)),
    Layout("system, prompt and response", ("system", "prompt", "response"), (Turn("=system", "system"), Turn("=user", "prompt"), Turn("=assistant", "response"))),
    Layout("prompt and response", ("prompt", "response"), (Turn("=user", "prompt"), Turn("=assistant", "response"))),
    Layout("prompt and completion", ("prompt", "completion"), (Turn("=user", "prompt"), Turn("=assistant", "completion"))),
    Layout("question and answer", ("question", "answer"), (Turn("=user", "question"), Turn("=assistant", "answer"))),
    Layout("instruction and output", ("instruction", "output"), (Turn("=user", "instruction\n\ninput"), Turn("=assistant", "output"))),
    Layout("prompt alone", ("prompt",), (Turn("=user", "prompt"),)),
    Layout("completion alone", ("completion",), (Turn("=assistant", "completion"),)),
    Layout("instruction alone", ("instruction",), (Turn("=system", "instruction"),)),
    Layout("bare row", ("turn",), (Turn("role", "text"),)),
)


def field_paths(record: object) -> frozenset[str]:
    """All nested field paths of a record; items of a list share theirs. Null fields count as absent."""
    found, todo = set(), [("", record)]
    while todo:
        at, x = todo.pop()
        if isinstance(x, dict):
            todo += [(f"{at}.{k}" if at else k, v) for k, v in x.items()]
        elif isinstance(x, list):
            todo += [(f"{at}[]", v) for v in x]
        elif x is not None:
            found.add(at)
    return frozenset(found)


def fingerprint(paths: frozenset[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def layout_of(paths: frozenset[str], layouts: tuple[Layout, ...] = LAYOUTS) -> Layout | None:
    fits = [x for x in layouts if paths.issuperset(x.needs)]
    return max(fits, key=lambda x: len(x.needs)) if fits else None


def _text(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _at(record: object, path: str) -> str:
    """The text at a path; lists on the way are joined, and fields separated by a blank line where both say something."""
    if "\n\n" in path:
        return "\n\n".join(t for t in (_at(record, p) for p in path.split("\n\n")) if t)
    here = [record]
    for step in path.split("."):
        name = step.removesuffix("[]")
        here = [x[name] for x in here if isinstance(x, dict) and name in x]
        if step.endswith("[]"):
            here = [y for x in here for y in (x if isinstance(x, list) else [x])]
    return "".join(map(_text, here))


def turns_of(record: dict, layout: Layout) -> list[tuple[str, str]]:
    out = []
    for t in layout.turns:
        for x in record.get(t.each) or [] if t.each else [record]:
            role = t.role[1:] if t.role.startswith("=") else _at(x, t.role)
            out.append((ROLES.get(role, role) if t.each else role, _at(x, t.text)))
    return out


MADE = "conv_id long, turn long, nth int, role string, text string, fingerprint string, layout string"


def mapped(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """conv_id, turn, record (JSON) to a row for each turn: conv_id, turn, nth (place in the record), role, text, fingerprint, layout. A record of
    no known layout has one row with null nth, role, text and layout."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[frozenset[str], tuple[str, Layout | None]] = {}
        for b in batches:
            rows = []
            for conv, turn, raw in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "record")), strict=True):
                try:
                    record = json.loads(raw) if raw is not None else None
                except ValueError:
                    record = None
                paths = field_paths(record) if isinstance(record, dict) else frozenset()
                if paths not in known:
                    if len(known) >= MAPPED:
                        known.clear()
                    known[paths] = fingerprint(paths), layout_of(paths, layouts)
                mark, layout = known[paths]
                if layout is None:
                    rows.append((conv, turn, None, None, None, mark, None))
                else:
                    rows += [(conv, turn, k, role, text, mark, layout.name) for k, (role, text) in enumerate(turns_of(record, layout))]
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.large_string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k).cast(pa.string()) if k == pa.large_string() else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split(" ")[0] for x in MADE.split(", ")])

    return records.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("record").cast("string")).mapInArrow(run, MADE)


def unmapped(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """How many records of each fingerprint no layout fits."""
    return mapped(records, layouts).filter(F.col("layout").isNull()).groupBy("fingerprint").agg(F.count("*").alias("n"))


BACK = {"\\": "\\", "h": "###", "e": "</turn>", "c": ":"}


def escaped(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for raw, mark in (("\\", "\\\\"), ("###", "\\h"), ("</turn>", "\\e")):
        out = F.replace(out, F.lit(raw), F.lit(mark))
    return out


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: BACK[m[1]], text) if "\\" in text else text


def write_formatted(spark: SparkSession, turns: DataFrame, piece: int = PIECE) -> DataFrame:
    """Stored pieces in order: conv_id, part, nth, formatted, and the spans of characters under the loss mask."""
    role, text = F.replace(escaped(F.col("role")), F.lit(":"), F.lit("\\c")), escaped(F.col("text"))
    rows = turns.select("conv_id", "turn", "nth", role.alias("role"), text.alias("text"), F.sha2("text", 256).alias("_hash"))
    order = ["conv_id", "turn", "nth", "role", "_hash"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth = TaskContext.get().partitionId(), 0
        now, texts, starts, ends, size = None, [], [], [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([now], pa.int64()), pa.array([part], pa.int32()), pa.array([nth], pa.int64()), pa.array(["".join(texts)], pa.string()), pa.array([starts], pa.list_(pa.int64())), pa.array([ends], pa.list_(pa.int64()))],
                ["conv_id", "part", "nth", "formatted", "loss_from", "loss_to"],
            )

        for b in batches:
            for conv, who, said in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if texts and (conv != now or size >= piece):
                    yield flush()
                    texts, starts, ends, size, nth = [], [], [], 0, nth + 1
                now = conv
                head = f"### {who}: "
                if who == "assistant":
                    starts.append(size + len(head))
                    ends.append(size + len(head) + len(said))
                texts.append(f"{head}{said}</turn>\n")
                size += len(texts[-1])
        if texts:
            yield flush()

    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pieces = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).select("conv_id", "role", "text").mapInArrow(run, "conv_id long, part int, nth long, formatted string, loss_from array<long>, loss_to array<long>")
    return stored(pieces, spark, "formatted")


def parsed(formatted: str) -> list[tuple[str, str]]:
    """The turns of a piece."""
    out = []
    for x in formatted.split("</turn>\n")[:-1]:
        head, _, text = x.removeprefix("### ").partition(": ")
        out.append((unescaped(head), unescaped(text)))
    return out


def read_formatted(pieces: DataFrame) -> DataFrame:
    """What the output says of each conversation, read piece by piece: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def done() -> tuple:
            return (now, state["n"], state["turns"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"])

        for b in batches:
            rows = []
            for conv, text, a, z in zip(*(b.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_from", "loss_to")), strict=True):
                if state is None or conv != now:
                    if state is not None:
                        rows.append(done())
                    now, state = conv, {"n": 0, "turns": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(), "chars": 0}
                for role, said in parsed(text):
                    state["n"] += 1
                    state["turns"].update(f"{role}\n{said}\n".encode())
                for i, j in zip(a, z, strict=True):
                    said = unescaped(text[i:j])
                    state["loss_chars"] += len(said)
                    state["loss"].update(said.encode())
                state["chars"] += len(text)
            yield batch_of(rows)
        if state is not None:
            yield batch_of([done()])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "nth").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def row_records(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as the records that feeds of single turns hold: a prompt, a completion or an instruction where the role says so, else role and content."""
    by_role = F.when(F.col("role") == "user", F.to_json(F.struct("turn", F.col("text").alias("prompt")))).when(F.col("role") == "assistant", F.to_json(F.struct("turn", F.col("text").alias("completion"))))
    by_role = by_role.when(F.col("role") == "system", F.to_json(F.struct("turn", F.col("text").alias("instruction")))).otherwise(F.to_json(F.struct("turn", F.struct("role", F.col("text").alias("content")).alias("message"))))
    plain = F.to_json(F.struct(F.coalesce("turn", F.lit(0)).alias("turn"), "role", "text"))
    return rows.select("conv_id", "turn", F.when(F.col("text").isNull() | F.col("role").isNull(), plain).otherwise(by_role).alias("record"))


def format_chats(spark: SparkSession, records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS, piece: int = PIECE) -> DataFrame:
    """Map, format, write, and read the output back: a row for each conversation."""
    turns = mapped(records, layouts).filter(F.col("layout").isNotNull())
    return read_formatted(write_formatted(spark, turns, piece))
