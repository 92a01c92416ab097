"""Chat formatting: a declarative template, and a state machine over roles.

A template lists the segments of a turn and which of them carry loss. Conversations pass through in
order, one turn at a time, and come out as text segments with a loss flag each; the segments of a
conversation joined are its training text. Control strings inside roles and texts are escaped, and
the formatted text can be read back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import query, table


@dataclass(frozen=True)
class Template:
    """``open role middle text close`` for every turn.

    ``moves`` is the state machine: from a state, by a role, to a state. A conversation is valid if
    every turn has a move and the last state accepts. ``control`` lists further strings that must not
    stand unescaped in formatted text. No control string may hold the escape character or begin
    anywhere inside another's end.
    """

    open: str = "<|im_start|>"
    middle: str = "\n"
    close: str = "<|im_end|>"
    learned: frozenset = frozenset({"assistant"})
    control: tuple = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    escape: str = "\\"
    start: str = "start"
    moves: dict = field(default_factory=lambda: {
        "start": {"system": "ready", "user": "asked"},
        "ready": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"},
    })
    accepting: frozenset = frozenset({"answered"})

    def pattern(self) -> re.Pattern:
        """What is escaped: the escape character, every control string, and what ends a role."""
        strings = sorted({self.escape, self.open, self.close, *self.control}, key=lambda s: (-len(s), s))
        return re.compile("|".join(map(re.escape, strings)))

    def escaped(self, text: str, pattern: re.Pattern) -> str:
        """The escape character goes before itself, and behind the first character of a control string."""
        def broken(m):
            s = m.group()
            return self.escape * 2 if s == self.escape else s[0] + self.escape + s[1:]

        return pattern.sub(broken, text)

    def plain(self, text: str) -> str:
        """The inverse of ``escaped``: each escape character stands for the character behind it."""
        if self.escape not in text:
            return text
        return re.sub(re.escape(self.escape) + r"(.)", r"\1", text, flags=re.S)


CHAT = Template()
SEGMENTS = "conv_id long, turn_no long, part int, text string, loss boolean, valid boolean"


def _ordered(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """Each conversation whole in one partition and in order: by turn, and where turns repeat by role and text."""
    rows = conversations.select(
        F.col(f"`{conv_id}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_chat(
    conversations: DataFrame, template: Template = CHAT, conv_id: str = "conv_id", turn: str = "turn",
    role: str = "role", text: str = "text",
) -> DataFrame:
    """One row per segment: ``conv_id, turn_no, part, text, loss, valid``, in order within partitions.

    ``turn_no`` counts from 0. ``valid`` says whether the turns so far, this one included, follow the
    state machine; on the last turn it also asks for an accepting state, so it is the conversation's
    verdict. Invalid conversations are formatted all the same. Null text and null role are empty;
    null ids form one conversation; null turns come first; repeated turns are kept, ordered by role
    and text. Only the text segment of a learned role carries loss.

    Turns stream through in sorted order, so memory holds two turns at a time, not a conversation.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pattern, state, number = template.pattern(), None, 0
        held, before = None, object()

        def segments(turn, last):
            conv, no, role, text, valid, accepts = turn
            ok = valid and (accepts or not last)
            # a role may not hold what ends it
            name = template.escaped(role, pattern).replace(template.middle, template.escape + template.middle)
            parts = (template.open, name, template.middle, template.escaped(text, pattern), template.close)
            return [(conv, no, k, part, k == 3 and role in template.learned, ok) for k, part in enumerate(parts)]

        for batch in batches:
            rows = []
            for conv, role, text in zip(batch["conv_id"].astype(object).where(batch["conv_id"].notna(), None), batch["role"], batch["text"]):
                fresh = conv != before
                if held is not None:
                    rows += segments(held, fresh)
                if fresh:
                    state, number, before = template.start, 0, conv
                state = template.moves.get(state, {}).get(role)  # None is a dead end
                held = (conv, number, role, text, state is not None, state in template.accepting)
                number += 1
            if rows:
                yield _frame(rows)
        if held is not None:
            yield _frame(segments(held, True))

    return _ordered(conversations, conv_id, turn, role, text).mapInPandas(run, SEGMENTS)


def _frame(rows: list) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["conv_id", "turn_no", "part", "text", "loss", "valid"])
    out["conv_id"] = out["conv_id"].astype("Int64")
    return out


READ = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
    "formatted_chars long, valid boolean"
)


def read_back(segments: DataFrame, template: Template = CHAT) -> DataFrame:
    """One row per conversation, read from its formatted text: turns, what is under the loss mask, lengths.

    Takes the output of ``format_chat`` with its order kept. Segments are appended to the text that
    is not yet read; a turn is read once its closing mark has come. Markers are found by their text
    alone, not by segment bounds.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, started = None, False

        def closed(c):
            if c["rest"]:
                raise ValueError(f"conversation {c['id']} does not end with a closed turn")
            return (c["id"], c["n"], c["turns"].hexdigest(), c["loss"], c["learned"].hexdigest(), c["chars"], c["valid"])

        def read(c):
            """Take the turn that has just been closed."""
            whole = c["rest"]
            if not whole.startswith(template.open):
                raise ValueError(f"conversation {c['id']} has text outside its turns")
            body = whole[len(template.open):-len(template.close)]
            at = 0
            while not body.startswith(template.middle, at):  # the first middle that is not escaped
                at += 2 if body.startswith(template.escape, at) else 1
            role, text = template.plain(body[:at]), template.plain(body[at + len(template.middle):])
            c["turns"].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            c["n"] += 1
            c["rest"] = ""

        for batch in batches:
            done = []
            ids = batch["conv_id"].astype(object).where(batch["conv_id"].notna(), None)
            for conv, text, loss, valid in zip(ids, batch["text"], batch["loss"], batch["valid"]):
                if not started or conv != now["id"]:
                    if started:
                        done.append(closed(now))
                    started = True
                    now = {"id": conv, "n": 0, "turns": hashlib.sha256(), "loss": 0, "learned": hashlib.sha256(), "chars": 0, "valid": True, "rest": ""}
                now["chars"] += len(text)
                now["valid"] = bool(valid)
                if loss:
                    learned = template.plain(text)
                    now["loss"] += len(learned)
                    now["learned"].update(learned.encode("utf-8", "surrogatepass"))
                now["rest"] += text
                if now["rest"].endswith(template.close):
                    read(now)
            if done:
                yield _read_frame(done)
        if started:
            yield _read_frame([closed(now)])

    return segments.mapInPandas(run, READ)


def _read_frame(rows: list) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in READ.split(", ")])
    out["conv_id"] = out["conv_id"].astype("Int64")
    return out


OP2_SQL = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
),
escaped AS (
  SELECT *, regexp_replace(
    regexp_replace(replace(text, '\\', '\\\\'), '(<)(\\|im_start\\|>|\\|im_end\\|>|s>|/s>|<SYS>>|</SYS>>)', '\\1\\\\\\2', 'g'),
    '(\\[)(/?INST\\])', '\\1\\\\\\2', 'g') AS safe
  FROM turns
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS no,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
    count(*) OVER (PARTITION BY conv_id) AS n
  FROM escaped
),
judged AS (
  SELECT *, CASE
      WHEN role = 'system' THEN no = 1
      WHEN role = 'user' THEN no = 1 OR before = 'assistant' OR (before = 'system' AND no = 2)
      WHEN role = 'assistant' THEN before = 'user' ELSE false END
    AND (no < n OR role = 'assistant') AS ok
  FROM placed
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(safe) + length(role) + length('<|im_start|>') + 1 + length('<|im_end|>'))::BIGINT AS formatted_chars,
  bool_and(ok) AS valid
FROM judged GROUP BY conv_id
"""


@query("op2_chat", OP2_SQL)
def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(format_chat(turns.unionByName(more)))
