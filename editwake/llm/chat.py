"""Chat formatting of typed content parts.

A message is a row of parts: text, images, audio and documents. A visitor walks
them in order: text is escaped, and each attachment becomes a placeholder,
while its reference and the tokens it expands to are recorded in order. Turns are put between marks, which no content can contain,
because the two characters that begin a mark are escaped inside texts, and so
is the escape character; reading back undoes it. A placeholder is a mark of its
own, ``<|part:image|>``, which reading back leaves as it is. The loss mask
covers the contents of assistant turns.

Everything is Column code, and one aggregation by conversation. Null texts are
empty, a null role is an empty role, and null parts are none. Turns with equal
numbers are ordered by role and text; repeated rows stay repeated. A null
conversation id is a conversation.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: What an attachment expands to where a part does not say it, in tokens.
EXPANDED = {"image": 576, "audio": 250, "document": 1024}

PART = "struct<kind:string,text:string,ref:string,tokens:int>"


def escaped(text: Column) -> Column:
    """The text without any beginning of a mark; ``unescaped`` gives it back."""
    quoted = F.replace(text, F.lit("&"), F.lit("&amp;"))
    return F.replace(quoted, F.lit("<|"), F.lit("&lt;|"))


def unescaped(text: Column) -> Column:
    """The reverse of ``escaped``."""
    plain = F.replace(text, F.lit("&lt;|"), F.lit("<|"))
    return F.replace(plain, F.lit("&amp;"), F.lit("&"))


def escaped_role(role: Column) -> Column:
    """A role on one line, without marks."""
    return F.replace(escaped(F.coalesce(role, F.lit(""))), F.lit("\n"), F.lit("&#10;"))


def unescaped_role(role: Column) -> Column:
    """The reverse of ``escaped_role``."""
    return unescaped(F.replace(role, F.lit("&#10;"), F.lit("\n")))


def text_parts(text: Column) -> Column:
    """A plain text as the parts of a message."""
    part = F.struct(
        F.lit("text").alias("kind"),
        F.coalesce(text, F.lit("")).alias("text"),
        F.lit(None).cast("string").alias("ref"),
        F.lit(None).cast("int").alias("tokens"),
    )
    return F.array(part)


def _is_text(part: Column) -> Column:
    return part["kind"].eqNullSafe(F.lit("text"))


def flattened(parts: Column) -> Column:
    """Visit parts in order: ``content`` with placeholders, and ``attachments``.

    An attachment is recorded with its place in the message, kind, reference
    and expanded tokens. Parts of an unknown kind are attachments of that kind.
    """
    parts = F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
    attached = F.filter(parts, lambda p: ~_is_text(p))
    kind = lambda p: F.coalesce(p["kind"], F.lit("unknown"))
    default = lambda p: F.coalesce(
        p["tokens"], *(F.when(p["kind"] == k, n) for k, n in EXPANDED.items()), F.lit(0)
    )
    said = lambda p: F.when(_is_text(p), escaped(F.coalesce(p["text"], F.lit("")))).otherwise(
        F.concat(F.lit("<|part:"), escaped_role(kind(p)), F.lit("|>"))
    )
    return F.struct(
        F.array_join(F.transform(parts, said), "").alias("content"),
        F.transform(
            attached,
            lambda p, i: F.struct(
                i.alias("place"), kind(p).alias("kind"), p["ref"].alias("ref"), default(p).alias("tokens")
            ),
        ).alias("attachments"),
    )


def formatted(
    messages: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    parts_col: str = "parts",
) -> DataFrame:
    """One row per conversation.

    ``formatted`` is the whole text, ``loss_mask`` has for each assistant turn
    its number and the begin and end of its content within the turn's block, in
    code points, ``attachments`` the references in order with their turns, and
    ``expanded_tokens`` what they amount to.
    """
    visited = messages.select(
        F.col(id_col).alias("id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        flattened(F.col(parts_col)).alias("flat"),
    )
    turn = F.struct("turn", "role", F.col("flat.content").alias("content"), F.col("flat.attachments").alias("attached"))
    grouped = visited.groupBy("id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    head = lambda t: F.concat(F.lit(START), escaped_role(t["role"]), F.lit("\n"))
    block = lambda t: F.concat(head(t), t["content"], F.lit(f"{END}\n"))
    spans = F.transform(
        "turns",
        lambda t, i: F.when(
            t["role"] == "assistant",
            F.struct(
                i.alias("turn"),
                F.length(head(t)).alias("begin"),
                (F.length(head(t)) + F.length(t["content"])).alias("end"),
            ),
        ),
    )
    attached = F.transform(
        "turns",
        lambda t, i: F.transform(
            t["attached"], lambda a: F.struct(i.alias("turn"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))
        ),
    )
    whole = grouped.select(
        F.col("id").alias(id_col),
        F.array_join(F.transform("turns", block), "").alias("formatted"),
        F.filter(spans, lambda s: s.isNotNull()).alias("loss_mask"),
        F.flatten(attached).alias("attachments"),
    )
    tokens = F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"])
    return whole.withColumn("expanded_tokens", tokens)


def read_back(chats: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What the formatted text says: ``turns`` with role and text, and ``loss_texts`` under the mask."""
    blocks = F.slice(F.split("formatted", r"<\|im_start\|>"), 2, F.length("formatted") + 1)
    bare = chats.withColumn("blocks", blocks)
    cut = len(START)

    def turn(block: Column) -> Column:
        role = F.substring_index(block, "\n", 1)
        size = F.length(block) - F.length(role) - 1 - len(END) - 1
        return F.struct(
            unescaped_role(role).alias("role"),
            unescaped(F.substring(block, F.length(role) + 2, size)).alias("text"),
        )

    masked = lambda s: F.substring(
        F.get("blocks", s["turn"]), s["begin"] - cut + 1, s["end"] - s["begin"]
    )
    return bare.select(
        id_col,
        "formatted",
        F.transform("blocks", turn).alias("turns"),
        F.transform("loss_mask", lambda s: unescaped(masked(s))).alias("loss_texts"),
    )


def digests(chats: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Counts and digests of what is read back from formatted conversations."""
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join("loss_texts", "")
    return read_back(chats, id_col).select(
        id_col,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, "").cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
