"""Chat formatting by a declarative template (DataFrame functions only).

A finite-state machine over roles validates the order of turns; each turn becomes segments of text
with a loss flag: the opening mark, the body and the closing mark, of which only bodies of trained
roles count for the loss.  Inside bodies the template's control strings and its own marks get one more
``%`` after their first character, so ``<|`` becomes ``<%|`` and ``<%|`` becomes ``<%%|``; taking one away
restores the text.

Defined results: a null text is empty, a null role is the empty role (which no transition takes),
null turns come first, equal turns stand by role and text, rows without a conv_id belong to no common
conversation (each different one is its own), an unknown role or a wrong order gives ``valid = false`` and still a formatted text,
an empty table gives an empty table; further columns are not read.  A conversation is one output
row, as its text is one string, so it must fit a row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The marks, the trained roles and the transitions of the default template.
TEMPLATE = {
    "open": "<|im_start|>",
    "after_role": "\n",
    "close": "<|im_end|>\n",
    "controls": ["<|", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]"],
    "loss_roles": ["assistant"],
    "start": "start",
    "accept": ["assistant"],
    "transitions": {
        "start": {"system": "system", "user": "user"},
        "system": {"user": "user"},
        "user": {"assistant": "assistant"},
        "assistant": {"user": "user"},
    },
}


def _marks(template: dict) -> tuple[str, str]:
    """Patterns of the first characters and of the rests of what must not occur inside a body."""
    marks = [*template["controls"], template["open"], template["close"]]
    close = template["close"]
    nested = any(x in m[1:] for m in marks if len(m) > 1 for x in marks)
    if min(map(len, marks)) < 2 or nested or any(close[:i] == close[-i:] for i in range(1, len(close))) or any(m[1] == "%" for m in marks):
        raise ValueError("marks need two characters, the second no %, none within another, and the closing mark must not begin as it ends")
    return "[" + "".join(sorted({re.escape(m[0]) for m in marks})) + "]", "|".join(sorted({re.escape(m[1:]) for m in marks}))


def escaped(text: Column, template: dict = TEMPLATE) -> Column:
    first, rest = _marks(template)
    return F.regexp_replace(text, f"({first})(%*)(?={rest})", "$1%$2")


def unescaped(text: Column, template: dict = TEMPLATE) -> Column:
    first, rest = _marks(template)
    return F.regexp_replace(text, f"({first})%(%*)(?={rest})", "$1$2")


def turn_pattern(template: dict = TEMPLATE) -> str:
    """Role (url-encoded) and body of a formatted turn."""
    return f"(?s){re.escape(template['open'])}([A-Za-z0-9%+*._-]*){re.escape(template['after_role'])}(.*?){re.escape(template['close'])}"


def end_state(roles: Column, template: dict = TEMPLATE) -> Column:
    """State after all roles, or ``invalid`` from the first role that has no transition."""
    moves = [(f"{a}>{r}", b) for a, by in template["transitions"].items() for r, b in by.items()]
    table = F.create_map(*[F.lit(x) for pair in moves for x in pair])
    return F.aggregate(
        roles,
        F.lit(template["start"]),
        lambda s, r: F.coalesce(F.try_element_at(table, F.concat(s, F.lit(">"), r)), F.lit("invalid")),
    )


def format_chats(turns: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """One row per conv_id: n_turns, valid, end_state, segments array<struct<text,loss>>, formatted."""
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    own = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text"))  # no group of all that lack an id
    chats = turns.groupBy("conv_id", own).agg(F.array_sort(F.collect_list(row)).alias("turns"))
    trained = [F.lit(r) for r in template["loss_roles"]]

    def parts(t: Column) -> Column:
        opened = F.concat(F.lit(template["open"]), F.url_encode(t["role"]), F.lit(template["after_role"]))
        return F.array(
            F.struct(opened.alias("text"), F.lit(False).alias("loss")),
            F.struct(escaped(t["text"], template).alias("text"), t["role"].isin(*trained).alias("loss")),
            F.struct(F.lit(template["close"]).alias("text"), F.lit(False).alias("loss")),
        )

    chats = chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        end_state(F.col("turns.role"), template).alias("end_state"),
        F.flatten(F.transform("turns", parts)).alias("segments"),
    )
    return chats.select(
        "conv_id",
        "n_turns",
        F.col("end_state").isin(*[F.lit(s) for s in template["accept"]]).alias("valid"),
        "end_state",
        "segments",
        F.array_join(F.col("segments.text"), "").alias("formatted"),
    )


def read_back(chats: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """Turns parsed from ``formatted`` and the text under the loss mask, both unescaped."""
    turn = turn_pattern(template)
    roles = F.regexp_extract_all("formatted", F.lit(turn), F.lit(1))
    bodies = F.regexp_extract_all("formatted", F.lit(turn), F.lit(2))
    turns = F.zip_with(roles, bodies, lambda r, b: F.struct(F.url_decode(r).alias("role"), unescaped(b, template).alias("text")))
    lost = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"], template))
    return chats.select("*", turns.alias("turns"), F.array_join(lost, "").alias("loss_text"))


def op8_chat(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    added = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(text).alias("text"),
    )
    chats = read_back(format_chats(turns.unionByName(added)))
    flat = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(flat, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(regexp_replace(text,
    '<(%*)(\||/?s>|</?SYS>>)', '<%\1\2', 'g'), '\[(%*)(/?INST\])', '[%\1\2', 'g') AS body FROM c),
g AS (SELECT conv_id, count(*)::BIGINT AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss_text,
    sum(length('<|im_start|>') + length(role) + 1 + length(body) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars,
    string_agg(role, '>' ORDER BY turn NULLS FIRST, role, text) AS roles FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(loss_text)::BIGINT AS loss_chars, sha256(loss_text) AS loss_sha256,
    formatted_chars, regexp_full_match(roles, '(system>)?user>assistant(>user>assistant)*') AS valid FROM g
"""
QUERIES = {"op8_chat": op8_chat}
ORACLES = {"op8_chat": ORACLE}
