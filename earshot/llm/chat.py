"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example: all turns before it are its context,
and only that reply is trainable. ``expanded`` writes every example out with its
whole context, as the query does. Turns after the last reply form a row that
trains nothing, with all turns before them.

A conversation's examples share their contexts, so ``prefix_targets`` has them
as deltas, to be stored: an example's row holds the formatted turns since the
one before it, and its full text is the deltas up to its own, in order
(``examples``). Each row says how many turns and characters its context has, and
carries a digest of them, by which a reader can tell that the deltas before it
are that context. Deltas grow with the input, however long a conversation is.

Template: ``<s>`` role, line feed, text, ``</s>``. Inside roles and texts a
backslash is doubled and put after the first character of each control string
(``<s>``, ``</s>``, ``[INST]``, ``[/INST]``, ``<|``); a line feed in a role gets
one before it. To read a string back, drop each backslash that begins a pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from earshot.llm.common import table

BEGIN, END = "<s>", "</s>"
_CONTROL = r"<(?=/?s>|\|)|\[(?=/?INST\])"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), _CONTROL, r"$0\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(BEGIN), F.replace(escaped(role), F.lit("\n"), F.lit("\\\n")), F.lit("\n"), escaped(text), F.lit(END))


def _xor(hashes: Column) -> Column:
    return F.aggregate(hashes, F.lit(0).cast("bigint"), lambda s, x: s.bitwiseXOR(x))


def _numbered(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, target: str) -> tuple[DataFrame, WindowSpec, WindowSpec]:
    """Turns (conv, role, text) with ``n`` (from 0 in a conversation), ``example`` (replies before) and ``piece`` (formatted), their order, and what is before a turn in it."""
    rows = turns.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    here = order.rowsBetween(Window.unboundedPreceding, -1)
    is_target = F.col("role") == target
    rows = rows.withColumns({"n": (F.row_number().over(order) - 1).cast("long"), "example": F.coalesce(F.sum(is_target.cast("long")).over(here), F.lit(0)).cast("long")})
    return rows.withColumn("piece", formatted_turn(F.col("role"), F.col("text"))), order, here


def expanded(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", target: str = "assistant") -> DataFrame:
    """Examples in full: each reply with all turns before it.

    Columns: the conversation's id, ``example`` (from 0), ``text`` (all formatted
    turns up to the reply, and the reply's), ``loss_start`` and ``loss_chars`` (the
    reply within ``text``, code points; null in a row that trains nothing) and
    ``last`` (whether ``text`` is the whole conversation). Order, ties and nulls are
    those of ``prefix_targets``. The result grows with the square of a conversation's
    length; a task holds the turns of a conversation and one example at a time.
    """
    rows, order, here = _numbered(turns, conv_col, turn_col, role_col, text_col, target)
    rows = rows.withColumns({"before": F.collect_list("piece").over(here), "last": F.lead("n").over(order).isNull()})
    is_target = F.col("role") == target
    rows = rows.where(is_target | F.col("last")).select(
        F.col("conv").alias(conv_col),
        "example",
        F.concat(F.array_join("before", ""), "piece").alias("text"),
        F.when(is_target, F.length(escaped(F.col("text")))).cast("long").alias("loss_chars"),
        "last",
    )
    return rows.select(conv_col, "example", "text", (F.length("text") - len(END) - F.col("loss_chars")).alias("loss_start"), "loss_chars", "last")


def prefix_targets(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", target: str = "assistant") -> DataFrame:
    """Examples as deltas.

    Columns: the conversation's id, ``example`` (from 0), ``delta`` (formatted
    turns), ``loss_start`` and ``loss_chars`` (the reply within ``delta``, code
    points; null in a row that trains nothing), and of the context, which is all
    of the conversation before the reply: ``context_chars`` (formatted characters),
    ``context_turns`` and ``context_digest`` (``xxhash64`` of each turn's number
    and formatted text, combined by exclusive or). Turns are ordered by number,
    ties by role, then text; repeated rows are turns of their own. Null texts and
    roles are empty; a null conversation id is an id.
    """
    rows, _, here = _numbered(turns, conv_col, turn_col, role_col, text_col, target)
    rows = rows.withColumn("digest", F.coalesce(F.bit_xor(F.xxhash64("n", "piece")).over(here), F.lit(0)))
    # the same partitioning by conversation serves the windows and this group
    deltas = rows.groupBy("conv", "example").agg(F.array_sort(F.collect_list(F.struct("n", "digest", "role", F.length(escaped(F.col("text"))).alias("chars"), "piece"))).alias("turns"))
    last = F.element_at("turns", -1)
    delta = F.array_join(F.transform("turns", lambda t: t["piece"]), "")
    # the reply is the delta's last turn; only a row of trailing turns has none
    of_reply = lambda x: F.when(last["role"] == target, x)
    out = deltas.select("conv", "example", delta.alias("delta"), of_reply(last["chars"]).alias("loss_chars"), of_reply(last["n"]).alias("context_turns"), of_reply(last["digest"]).alias("context_digest"))
    out = out.withColumn("loss_start", F.length("delta") - len(END) - F.col("loss_chars"))
    before = Window.partitionBy("conv").orderBy("example").rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("context_chars", F.coalesce(F.sum(F.length("delta")).over(before), F.lit(0)) + F.col("loss_start"))
    return out.select(
        F.col("conv").alias(conv_col),
        "example",
        "delta",
        F.col("loss_start").cast("long"),
        F.col("loss_chars").cast("long"),
        F.col("context_chars").cast("long"),
        "context_turns",
        "context_digest",
    )


def examples(deltas: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Full examples: the id, ``example``, ``context`` and ``reply`` as formatted text.

    Every context is written out, so the result grows with the square of a
    conversation's length; the deltas are the form to store.
    """
    upto = Window.partitionBy(conv_col).orderBy("example").rowsBetween(Window.unboundedPreceding, 0)
    full = deltas.withColumn("_text", F.array_join(F.collect_list("delta").over(upto), "")).where("loss_chars is not null")
    return full.select(
        conv_col,
        "example",
        F.substring("_text", F.lit(1), F.col("context_chars").cast("int")).alias("context"),
        F.substring("_text", (F.col("context_chars") + 1).cast("int"), F.col("loss_chars").cast("int")).alias("reply"),
    )


def raw_turns(formatted: Column) -> Column:
    """The formatted turns of a text, each without its end."""
    return F.slice(F.split(formatted, END, -1), 1, F.greatest(F.size(F.split(formatted, END, -1)) - 1, F.lit(0)))


def read_turns(raw: Column) -> Column:
    """Turns (role, text) of formatted ones."""
    # the first line feed without a backslash before it ends the role
    head = r"(?s)^<s>((?:[^\\\n]++|\\.)*+)\n(.*)$"
    return F.transform(raw, lambda t: F.struct(unescaped(F.regexp_extract(t, head, 1)).alias("role"), unescaped(F.regexp_extract(t, head, 2)).alias("text")))


def _contexts_hold(examples: Column, raw: Column, target: str) -> Column:
    """Whether each example's context is, by turns, characters and digest, what the conversation read back holds before its reply.

    Contexts grow: each adds to the one before it the turns since that reply, so
    that all of them are compared in one walk over the turns.
    """
    hashes = F.transform(raw, lambda t, i: F.xxhash64(i.cast("bigint"), F.concat(t, F.lit(END))))
    chars = F.transform(raw, lambda t: F.length(t) + len(END))
    trained = F.filter(examples, lambda x: x["context_turns"].isNotNull())
    start = F.struct(F.lit(True).alias("good"), *(F.lit(0).cast("bigint").alias(c) for c in ("turns", "digest", "chars")))
    head = len(BEGIN) + len(target) + 1

    def walk(w: Column) -> Column:
        def step(state: Column, x: Column) -> Column:
            many = (x["context_turns"] - state["turns"]).cast("int")
            since = lambda values: F.slice(values, (state["turns"] + 1).cast("int"), F.greatest(many, F.lit(0)))
            digest = state["digest"].bitwiseXOR(_xor(since(w["hashes"])))
            size = state["chars"] + F.aggregate(since(w["sizes"]), F.lit(0).cast("bigint"), lambda s, y: s + y)
            good = state["good"] & (many >= 0) & (digest == x["context_digest"]) & (size + head == x["context_chars"])
            return F.struct(good.alias("good"), x["context_turns"].alias("turns"), digest.alias("digest"), size.alias("chars"))

        return F.aggregate(w["xs"], start, step, lambda s: s["good"])

    return F.transform(F.array(F.struct(trained.alias("xs"), hashes.alias("hashes"), chars.alias("sizes"))), walk)[0]


def _read_back(rows: DataFrame, target: str) -> DataFrame:
    """``conv_id``, ``formatted`` (the whole conversation), ``turns`` read from it, ``trained`` (what the examples train, unescaped) and
    ``sound``: whether every example's context is all of the conversation before its reply, and every reply has one.

    A context is so if it ends where a reply begins, has as many turns as come before that reply, and is how the conversation begins.
    """
    context = F.substring("text", F.lit(1), F.col("loss_start").cast("int"))
    reply = F.substring("text", (F.col("loss_start") + 1).cast("int"), F.col("loss_chars").cast("int"))
    ends = ((F.length(context) - F.length(F.replace(context, F.lit(END), F.lit("")))) / len(END)).cast("int")
    opened = F.endswith(context, F.lit(f"{BEGIN}{target}\n"))
    x = F.struct("example", unescaped(reply).alias("reply"), F.when(opened, ends).alias("context_turns"), F.col("loss_start").alias("chars"), F.xxhash64(context).alias("hash"), F.when(F.col("last"), F.col("text")).alias("whole"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(x)).alias("xs"))
    whole = whole.select("conv_id", F.filter("xs", lambda x: x["chars"].isNotNull()).alias("xs"), F.element_at("xs", -1)["whole"].alias("formatted"))
    whole = whole.withColumn("turns", read_turns(raw_turns(F.col("formatted"))))
    replies = F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == target, i)), lambda i: i.isNotNull())
    begins = F.forall("xs", lambda x: F.xxhash64(F.substring("formatted", F.lit(1), x["chars"].cast("int"))) == x["hash"])
    sound = replies.eqNullSafe(F.transform("xs", lambda x: x["context_turns"])) & begins
    return whole.select("conv_id", "formatted", "turns", F.array_join(F.transform("xs", lambda x: x["reply"]), "").alias("trained"), F.coalesce(sound, F.lit(False)).alias("sound"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read back from the full examples: replies are cut from each, turns are read from the last, and every context must be the turns before its reply."""
    talks = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], talks.schema)
    whole = _read_back(expanded(talks.unionByName(planted)), "assistant")
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    n_turns = F.when(F.col("sound"), F.size("turns")).otherwise(F.raise_error(F.lit("an example's context is not the turns before its reply")).cast("int"))
    return whole.select(
        "conv_id",
        n_turns.cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql_length(x: str) -> str:
    """Characters of an escaped string: one more for each backslash and control string."""
    more = [(c, len(c)) for c in ("\\", "<s>", "</s>", "[INST]", "[/INST]", "<|")]
    return " + ".join([f"length({x})", *(f"(length({x}) - length(replace({x}, '{c}', ''))) // {n}" for c, n in more)])


OP3_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS lines,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS trained,
    CAST(sum(8 + {_sql_length("role")} + length(role) - length(replace(role, chr(10), '')) + {_sql_length("text")}) AS BIGINT) AS formatted_chars
  FROM t GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(lines) AS turns_sha256, length(trained) AS loss_chars, sha256(trained) AS loss_sha256, formatted_chars FROM g
"""
