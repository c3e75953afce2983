"""Chat formatting with loss masks, from a template that is called as a black box.

A template is a function of turns (and of the role whose turn is about to come) that returns a string. It is called on
successive prefixes of a conversation; where each output begins with the one before, the rest is the new turn's span.
Where it does not, the template rewrites history and the conversation is marked. Within a span the text lies after what
the template gives as the prompt for that role, and before what it adds to an empty text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Turns = Sequence[tuple[str, str]]
Template = Callable[[Turns, "str | None"], str]

#: Fixed values of the format: strings that control a model's reading, never left whole inside a text.
START, END = "<|turn|>", "<|end|>"
CONTROL = (START, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
_ESCAPE = re.compile("|".join(["\\\\", *(re.escape(c) for c in sorted(CONTROL, key=len, reverse=True))]))
_UNESCAPE = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """Reversible: a backslash is doubled, and one is put after the first character of each control string."""
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def marked_template(turns: Turns, coming: str | None = None) -> str:
    """The default template: ``<|turn|>role``, a newline, the text, ``<|end|>`` and a newline for each turn."""
    out = [f"{START}{_role(r)}\n{escape(t)}{END}\n" for r, t in turns]
    return "".join(out) + (f"{START}{_role(coming)}\n" if coming is not None else "")


def _role(role: str) -> str:
    """A role as one line: newlines are written as backslash and n... by the escape's own rule for single characters."""
    return escape(role).replace("\n", "\\\n")


_TURN = re.compile(re.escape(START) + r"((?:[^\\\n]|\\.)*)\n((?:[^\\]|\\.)*?)" + re.escape(END) + r"\n", re.S)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns that the default template wrote; raises ValueError on anything else."""
    out, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            break
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"not a formatted conversation at {at}")
    return out


class Rendered:
    """A conversation as rendered: the string, each turn's (start, end), each text's (start, end), and whether history
    was rewritten; spans are None from the first rewritten turn on."""

    def __init__(self, text: str, turns: list, texts: list, rewrites: bool):
        self.text, self.turns, self.texts, self.rewrites = text, turns, texts, rewrites


class AppendTemplate:
    """A template that adds to its output for each turn: ``turn(role, text)``, after ``prompt(role)`` for one to come. It is
    rendered turn by turn, so long conversations cost their length; any other template renders each prefix anew."""

    def __init__(self, turn: Callable[[str, str], str], prompt: Callable[[str], str]):
        self.turn, self.prompt = turn, prompt

    def __call__(self, turns: Turns, coming: str | None = None) -> str:
        return "".join(self.turn(r, t) for r, t in turns) + (self.prompt(coming) if coming is not None else "")


def render(turns: Turns, template: Template = marked_template) -> Rendered:
    """Render successive prefixes and locate each turn by comparing consecutive outputs."""
    if isinstance(template, AppendTemplate):
        return _appended(turns, template)
    before, spans, texts, rewrites = template([], None), [], [], False
    for k, (role, text) in enumerate(turns):
        now = template(turns[: k + 1], None)
        if not now.startswith(before) or rewrites:
            rewrites = True
            spans.append(None)
            texts.append(None)
        else:
            spans.append((len(before), len(now)))
            prompt, blank = template(turns[:k], role), template([*turns[:k], (role, "")], None)
            inside = None
            if prompt.startswith(before) and now.startswith(prompt) and blank.startswith(prompt):
                tail = blank[len(prompt) :]
                if now.endswith(tail) and len(prompt) + len(tail) <= len(now):
                    inside = (len(prompt), len(now) - len(tail))
            texts.append(inside)
        before = now
    return Rendered(before, spans, texts, rewrites)


def _appended(turns: Turns, template: AppendTemplate) -> Rendered:
    """The same, of what each turn adds: nothing before it can change."""
    parts, spans, texts, at = [], [], [], 0
    for role, text in turns:
        own, prompt, blank = template.turn(role, text), template.prompt(role), template.turn(role, "")
        inside = None
        if own.startswith(prompt) and blank.startswith(prompt):
            tail = blank[len(prompt) :]
            if own.endswith(tail) and len(prompt) + len(tail) <= len(own):
                inside = (at + len(prompt), at + len(own) - len(tail))
        parts.append(own)
        spans.append((at, at + len(own)))
        texts.append(inside)
        at += len(own)
    return Rendered("".join(parts), spans, texts, False)


def format_conversations(
    turns: DataFrame,
    template: Template = marked_template,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    trained_roles: tuple[str, ...] = ("assistant",),
) -> DataFrame:
    """One row a conversation: conv_id, formatted, loss_spans (start and end of each trained text, in code points),
    turn_spans, n_turns, rewrites_history.

    Turns are ordered by number, then role, then text; null turn numbers come first, null roles and texts count as empty.
    Rows without a conversation id form one conversation with a null id. Repeated rows are repeated turns. A conversation
    is formatted whole, by one task, as its string is one value. Where history is rewritten the spans found until then
    stay and later ones are left out. An empty table gives an empty result; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.list_(pa.list_(pa.int64()))
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                text, loss, spans, count, rewrites = [], [], [], [], []
                for found in part.column(1).to_pylist():
                    own = [(t["r"], t["x"]) for t in found]
                    r = render(own, template)
                    text.append(r.text)
                    loss.append([list(s) for (role, _), s in zip(own, r.texts, strict=True) if s and role in trained_roles])
                    spans.append([list(s) for s in r.turns if s])
                    count.append(len(own))
                    rewrites.append(r.rewrites)
                yield pa.record_batch([part.column(0), pa.array(text, pa.string()), pa.array(loss, kinds), pa.array(spans, kinds), pa.array(count, pa.int64()), pa.array(rewrites)], names=["conv_id", "formatted", "loss_spans", "turn_spans", "n_turns", "rewrites_history"])

    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    one = F.struct(F.col(turn_col).cast("long").alias("n"), empty(role_col).alias("r"), empty(text_col).alias("x"))
    whole = turns.select(F.col(id_col).cast("long").alias("conv_id"), one.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return whole.mapInArrow(run, "conv_id long, formatted string, loss_spans array<array<long>>, turn_spans array<array<long>>, n_turns long, rewrites_history boolean")


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations of the default template: the digest columns of the query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        for batch in batches:
            rows = []
            for i, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = read_back(text)
                all_turns = "".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8", "surrogatepass")
                loss = "".join(unescape(text[a:b]) for a, b in spans)
                rows.append((i, len(turns), hashlib.sha256(all_turns).hexdigest(), len(loss), hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), len(text)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.record_batch([pa.array([r[k] for r in rows], kinds[k]) for k in range(6)], names=names)

    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: The conversation that the query adds: both turns hold control strings.
ADDED = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``conversations``, and conversation -7."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame(ADDED, "conv_id long, turn long, role string, text string")
    return digests(format_conversations(turns.unionByName(added)))


OP2_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), e AS (
  SELECT *, regexp_replace(replace(text, '\\', '\\\\'), '(<)(\\|turn\\|>|\\|end\\|>|s>|/s>|<SYS>>|</SYS>>|\\|im_start\\|>|\\|im_end\\|>|\\|endoftext\\|>)|(\\[)(INST\\]|/INST\\])', '\\1\\3\\\\\\2\\4', 'g') AS x FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|turn|>' || role || chr(10) || x || '<|end|>' || chr(10)))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
