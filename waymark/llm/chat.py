"""Chat formatting that is checked by parsing it back, in SQL functions only.

    conversation := "#" level "\\n" turn*
    turn         := open text close

    role       open                 close
    user       [INST]               [/INST]
    system     <<SYS>>              <</SYS>>
    assistant  <s>                  </s>
    any other  <|role:NAME|>        <|end|>
    null       <|role|>             <|end|>

At level 0 texts stand as they are. The rendered text is parsed by this grammar,
and if the turns that come back are not those that went in, the conversation is
rendered at level 1, where texts are escaped: a backslash is doubled, and one is
put after the first character of whatever could be read as a mark, so no mark is
left in a text, and dropping each backslash that stands before a character gives
the text back. That, too, is parsed and compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.quality import let

_MARK = r"</?s>|\[/?INST\]|<</?SYS>>|<\|role(?::[^|]*)?\|>|<\|end\|>"
#: The first character of a possible mark.
_START = r"(<(?=/?s>|</?SYS>>|\|)|\[(?=/?INST\]))"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _START, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _open(role: Column) -> Column:
    name = F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("|"), F.lit("%7C"))
    return F.when(role == "user", "[INST]").when(role == "system", "<<SYS>>").when(role == "assistant", "<s>").when(role.isNull(), "<|role|>").otherwise(F.concat(F.lit("<|role:"), name, F.lit("|>")))


def _close(role: Column) -> Column:
    return F.when(role == "user", "[/INST]").when(role == "system", "<</SYS>>").when(role == "assistant", "</s>").otherwise("<|end|>")


def _role(mark: Column) -> Column:
    """The role that an opening mark names."""
    name = F.replace(F.replace(F.regexp_extract(mark, r"<\|role:([^|]*)\|>", 1), F.lit("%7C"), F.lit("|")), F.lit("%25"), F.lit("%"))
    return F.when(mark == "[INST]", "user").when(mark == "<<SYS>>", "system").when(mark == "<s>", "assistant").when(mark.startswith("<|role:"), name)


def parse(formatted: Column) -> Column:
    """The turns, array<struct<role, text>>, of a formatted conversation; null if it does not follow the grammar."""
    level, body = F.substring(formatted, 2, 1), F.regexp_replace(formatted, r"\A#\d\n", "")

    def turns(marks: Column, parts: Column) -> Column:
        one = lambda i: F.struct(
            _role(F.get(marks, 2 * i)).alias("role"),
            F.when(level == "1", unescape(F.get(parts, 2 * i + 1))).otherwise(F.get(parts, 2 * i + 1)).alias("text"),
        )
        right = lambda i: (F.get(parts, 2 * i) == "") & (F.get(marks, 2 * i + 1) == _close(_role(F.get(marks, 2 * i)))) & F.get(marks, 2 * i).rlike(r"\A(<s>|\[INST\]|<<SYS>>|<\|role)")
        n = (F.size(marks) / 2).cast("int")
        each = F.sequence(F.lit(0), n - 1)
        good = (F.size(marks) % 2 == 0) & (F.element_at(parts, -1) == "") & F.when(n == 0, True).otherwise(F.forall(each, right))
        return F.when(good, F.when(n == 0, F.array().cast("array<struct<role:string,text:string>>")).otherwise(F.transform(each, one)))

    return let(F.regexp_extract_all(body, F.lit(f"({_MARK})"), 1), lambda marks: let(F.split(body, _MARK), lambda parts: turns(marks, parts)))


def format_conversations(rows: DataFrame) -> DataFrame:
    """``(conv_id, level, formatted, loss)`` for each conversation of ``rows`` (conv_id, turn, role, text).

    Turns stand in order of (turn, role, text), nulls first; a null text is empty;
    a null role has marks of its own; rows without a conv_id are one conversation.
    loss: where the assistant's texts stand in ``formatted``, as characters from
    start to before stop, and as bytes of its UTF-8 from first to before last, each
    once and in order. A conversation must fit a row; repeated rows are turns like
    others; other columns are not read; no rows give none.
    Raises an error should level 1 not come back as it was.
    """
    text = F.coalesce("text", F.lit(""))
    turn = rows.select("conv_id", "turn", "role", text.alias("text"))
    raised = turn.select("*", escape(F.col("text")).alias("_safe"), _open(F.col("role")).alias("_open"), _close(F.col("role")).alias("_close"))
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)

    def start(size, t: str) -> Column:
        return (F.coalesce(F.sum(size("_open") + size(t) + size("_close")).over(before), F.lit(0)) + 3 + size("_open")).cast("long")

    sizes = {"c": F.char_length, "b": F.octet_length}
    placed = raised.select("*", *(start(size, t).alias(f"_{k}{i}") for k, size in sizes.items() for i, t in enumerate(("text", "_safe"))))
    together = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "_c0", "_c1", "_b0", "_b1", "_safe", "_open", "_close"))).alias("t"))

    def rendered(level: int, field: str) -> Column:
        return F.concat(F.lit(f"#{level}\n"), F.array_join(F.transform("t", lambda x: F.concat(x["_open"], x[field], x["_close"])), ""))

    source = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    plain = together.withColumn("_plain", rendered(0, "text")).withColumn("_source", source)
    level = plain.withColumn("level", F.when(parse(F.col("_plain")).eqNullSafe(F.col("_source")), 0).otherwise(1))
    out = level.withColumn("formatted", F.when(F.col("level") == 0, F.col("_plain")).otherwise(rendered(1, "_safe")))
    same = (F.col("level") == 0) | parse(F.col("formatted")).eqNullSafe(F.col("_source"))
    out = out.withColumn("formatted", F.when(same, F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation did not come back as it was")).cast("string")))
    spoken = F.filter("t", lambda x: x["role"].eqNullSafe("assistant"))
    held = lambda x: F.when(F.col("level") == 0, x["text"]).otherwise(x["_safe"])
    at = lambda x, k: F.when(F.col("level") == 0, x[f"_{k}0"]).otherwise(x[f"_{k}1"])
    end = lambda x, k: at(x, k) + sizes[k](held(x))
    loss = F.transform(spoken, lambda x: F.struct(at(x, "c").alias("start"), end(x, "c").alias("stop"), at(x, "b").alias("first"), end(x, "b").alias("last")))
    return out.select("conv_id", "level", "formatted", loss.alias("loss"))


def turns(formatted: DataFrame) -> DataFrame:
    """``formatted`` with ``turns``, parsed from its text."""
    return formatted.withColumn("turns", parse(F.col("formatted")))


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between. Spans are cut by bytes, so none is searched from the start."""
    cut = lambda body: F.transform(loss, lambda s: F.substring(body, (s["first"] + 1).cast("int"), (s["last"] - s["first"]).cast("int")).cast("string"))
    plain = F.transform(let(formatted.cast("binary"), cut), lambda x: F.when(F.substring(formatted, 2, 1) == "1", unescape(x)).otherwise(x))
    return F.array_join(plain, "")
