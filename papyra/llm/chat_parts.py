"""Chat formatting with typed content parts, in DataFrame functions only.

A turn's content is an array of parts (text, image, audio, document). Visiting the parts in order, a text part gives
its escaped text; any other part gives a placeholder ``<|kind:n|>``, n counting the conversation's attachments, and an
attachment record: kind, reference, and the tokens that the placeholder expands to (image: tiles x tokens of a tile;
audio: seconds x tokens of a second; document: pages x tokens of a page). A conversation becomes

    <|im_start|>role<|im_sep|>content<|im_end|>

for each turn, one after another, with ``segments`` (the same output in pieces) and ``loss`` (one flag for each piece; a
trainer sees the pieces flagged, the text parts of assistant turns, never a placeholder). Texts, roles and kinds can't forge control strings,
however a text is split into parts: each character is escaped by itself (``\\`` becomes ``\\\\``, ``|`` becomes ``\\|``),
so what joins has no bare ``|``, and every bare ``|`` is one of a control string. ``unescape`` takes it back.
``read_turns`` gives the texts, ``read_parts`` the parts, in which neighbouring texts are one and empty texts are gone.

Defined results: null text or role is empty, a null kind is text; null parts are none; null units are 1, those below 0
are 0, and tokens are 64-bit; null conversation or turn ids are values of their own, first in order; turns of equal
number are ordered by role, then parts; repeated rows are turns of their own; an empty table gives none; other columns
are ignored. A conversation is one output row, so its turns meet in one task: its sha256 and its string are defined over
all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Tokens of one tile, one second, one page.
UNIT_TOKENS = {"image": 256, "audio": 25, "document": 400}
PART = "struct<kind: string, text: string, ref: string, units: int>"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"\\([\\|])", "$1")


def text_parts(text: Column) -> Column:
    """The parts of a turn that is plain text."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("units")))


def is_text(p: Column) -> Column:
    return F.coalesce(p["kind"], F.lit("text")) == "text"


def visit(parts: Column, first: Column) -> Column:
    """Content of a turn, a string for each part; its first attachment has number ``first``. Linear in the parts: each looks at itself only."""
    files = F.filter(F.transform(parts, lambda p, i: F.when(~is_text(p), i)), lambda i: i.isNotNull())
    number = lambda i: (first + F.array_position(files, i) - 1).cast("string")
    shown = F.transform(parts, lambda p, i: F.when(is_text(p), escape(F.coalesce(p["text"], F.lit("")))).otherwise(F.concat(F.lit("<|"), escape(p["kind"]), F.lit(":"), number(i), F.lit("|>"))))
    return F.coalesce(shown, F.array().cast("array<string>"))


def attachments(parts: Column) -> Column:
    units = lambda p: F.greatest(F.coalesce(p["units"], F.lit(1)), F.lit(0)).cast("long")
    tokens = lambda p: units(p) * F.coalesce(*[F.when(p["kind"] == k, n) for k, n in UNIT_TOKENS.items()], F.lit(1))
    files = F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: ~is_text(p))
    return F.transform(files, lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), tokens(p).alias("tokens")))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, segments, loss, attachments, attachment_tokens from rows (conv_id, turn, role, parts)."""
    rows = turns.select("conv_id", F.struct(F.col("turn").isNotNull().alias("known"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.col("parts").alias("parts")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    chats = chats.withColumn("files", F.transform("turns", lambda t: attachments(t["parts"])))
    counted = F.aggregate(
        F.transform("files", lambda f: F.size(f)), F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("firsts")), lambda s, n: F.struct((s["n"] + n).alias("n"), F.concat(s["firsts"], F.array(s["n"])).alias("firsts"))
    )
    none = F.aggregate(F.transform("files", lambda f: F.size(f)), F.lit(0), lambda s, n: s + n) == 0
    chats = chats.withColumn("firsts", F.when(none, F.transform("turns", lambda t: F.lit(0))).otherwise(counted["firsts"]))
    content = F.zip_with("turns", "firsts", lambda t, first: F.struct(t["role"].alias("role"), visit(t["parts"], first).alias("content")))
    pieces = F.transform(content, lambda t: F.concat(F.array(F.concat(F.lit(START), escape(t["role"]), F.lit(SEP))), t["content"], F.array(F.lit(END))))
    texts = lambda t: F.transform(F.coalesce(t["parts"], F.array().cast(f"array<{PART}>")), lambda p: is_text(p) & (t["role"] == "assistant"))
    marks = F.transform("turns", lambda t: F.concat(F.array(F.lit(False)), texts(t), F.array(F.lit(False))))
    out = chats.select("conv_id", F.flatten(pieces).alias("segments"), F.flatten(marks).alias("loss"), F.flatten("files").alias("attachments"))
    tokens = F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["tokens"])
    return out.select("conv_id", F.array_join("segments", "").alias("formatted"), "segments", "loss", "attachments", tokens.alias("attachment_tokens"))


def _parted(formatted: Column) -> Column:
    """Role and content of every turn, as written. A bare ``|`` is in control strings only, so splitting at them is exact."""
    split = F.split(formatted, r"<\|im_start\|>")
    turns = F.slice(split, F.lit(2), F.size(split))
    return F.transform(turns, lambda t: F.split(F.substring(t, 1, F.length(t) - len(END)), r"<\|im_sep\|>"))


def read_turns(formatted: Column) -> Column:
    """Role and text of every turn, from the formatted string (placeholders stay as they are)."""
    return F.transform(_parted(formatted), lambda p: F.struct(unescape(p[0]).alias("role"), unescape(p[1]).alias("text")))


def read_parts(formatted: Column, files: Column) -> Column:
    """Role and parts (kind, text, ref, tokens) of every turn, from the formatted string and its attachments."""
    def part(piece: Column) -> Column:
        number = F.try_element_at(F.regexp_extract_all(piece, F.lit(r":(\d+)\|>$"), F.lit(1)), F.lit(1)).cast("int")
        file = F.get(files, number)
        placed = F.startswith(piece, F.lit("<|"))
        text = F.when(~placed, unescape(piece))
        return F.struct(F.when(placed, file["kind"]).otherwise("text").alias("kind"), text.alias("text"), F.when(placed, file["ref"]).alias("ref"), F.when(placed, file["tokens"]).alias("tokens"))

    # before a bare <| and after a placeholder's end; no group repeats, so long texts need no deep recursion
    pieces = lambda c: F.filter(F.split(c, r"(?=<\|)|(?<=\d\|>)"), lambda x: x != "")
    return F.transform(_parted(formatted), lambda p: F.struct(unescape(p[0]).alias("role"), F.transform(pieces(p[1]), part).alias("parts")))


def loss_text(segments: Column, loss: Column) -> Column:
    """All text under the mask, unescaped."""
    kept = F.filter(F.arrays_zip(segments.alias("s"), loss.alias("m")), lambda z: z["m"])
    return F.array_join(F.transform(kept, lambda z: unescape(z["s"])), "")
