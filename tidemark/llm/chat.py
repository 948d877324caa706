"""Chat formatting: conversations as token-budgeted, turn-aligned windows of one template.

A turn is written as [TURN role]text</s>. Inside roles and texts the characters that control
strings need are written with a backslash: \\ as \\s, < as \\l, [ as \\b, ] as \\e; so no text can
forge a mark, and since a backslash always begins such a pair, plain replacements undo it.

Prefix sums of turn tokens place turns in spans. The stride is the budget without the system turn
and the history. Turns within one stride cell of their conversation are a span; a turn across a
border of cells opens the span of the later cell if both fit the stride, else it is a span by
itself. A window is a span after the system turn and the last turns before the span, as far as
these fit the history. A turn is a target once: in the window where it is new. Turns are never
cut. A turn over the stride is a window of its own, without history, and with the system turn only
if both fit the budget; only a turn over the whole budget makes a window over it.

Prefix sums are taken in steps of the turn numbers first and over the steps' sums then, so that a
long conversation is no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut

#: Fixed values of the template: what is escaped, and how.
ESCAPES = [("\\", "\\s"), ("<", "\\l"), ("[", "\\b"), ("]", "\\e")]
OPEN, CLOSE, END = "[TURN ", "]", "</s>"
#: Turn numbers whose sums are taken together.
_STEP = 1024


def escape(text: Column) -> Column:
    for plain, written in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    for plain, written in reversed(ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def written(role: Column, body: Column) -> Column:
    """The turn in the template."""
    return F.concat(F.lit(OPEN), escape(role), F.lit(CLOSE), escape(body), F.lit(END))


def tokens(role: Column, body: Column) -> Column:
    """A turn's tokens, reckoned as one for each four characters of its written form, rounded up."""
    return F.ceil(F.length(written(role, body)) / 4)


def _same(a: DataFrame, b: DataFrame, *names: str) -> Column:
    cond = F.lit(True)
    for n in names:
        cond &= a[n].eqNullSafe(b[n])
    return cond


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with `at` (from 1) and `a` (tokens before, the system turn apart) in their conversations.

    Local numbers and sums go over _STEP turn numbers; what lies before is summed over the steps.
    """
    order = Window.partitionBy("conv_id", "step").orderBy("turn", "role", "body")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("step", F.floor(F.col("turn") / _STEP))
    sums = rows.groupBy("conv_id", "step").agg(F.count("*").alias("count"), F.sum("size").alias("sum"))
    steps = Window.partitionBy("conv_id").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("conv_id").alias("c"), F.col("step").alias("s"), F.coalesce(F.sum("count").over(steps), F.lit(0)).alias("n0"), F.coalesce(F.sum("sum").over(steps), F.lit(0)).alias("a0"))
    local = rows.withColumn("n1", F.row_number().over(order)).withColumn("a1", F.coalesce(F.sum("size").over(before), F.lit(0)))
    met = local.join(sums, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("step").eqNullSafe(F.col("s")))
    return met.select("conv_id", "role", "body", "size", (F.col("n0") + F.col("n1")).alias("at"), (F.col("a0") + F.col("a1")).alias("a"))


def windows(turns: DataFrame, budget: int = 2048, history: int = 256, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", target: str = "assistant") -> DataFrame:
    """Rows (conv_id, window, text, tokens, n_repeated, loss_spans) in the template.

    window counts from 1; tokens are those of its turns, at most the budget unless one turn has
    more; n_repeated leading turns are repeats; loss_spans are (start, stop) code points of text:
    the escaped texts of target turns that are new here. Turns go by turn (null first), then role
    and text where turns tie; a null text or role is empty; null conversation ids are one
    conversation; an empty table gives no windows; other columns are not read.

    A first turn of role system is kept at the head of each window if it has at most a quarter of
    the budget; a longer one is a turn like others. history is half the budget at most.
    """
    if not 0 <= history <= budget // 2:
        raise ValueError("history must be at most half the budget")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("body"))
    # Written once, as turns meet their spans, the history and the system turn from here.
    rows = cut(_numbered(rows.withColumn("size", tokens(F.col("role"), F.col("body")))))
    is_system = (F.col("at") == 1) & (F.col("role") == "system") & (F.col("size") <= budget // 4)
    system = rows.where(is_system).select(F.col("conv_id").alias("s_conv"), F.col("role").alias("s_role"), F.col("body").alias("s_body"), F.col("size").alias("fixed"))
    rows = rows.where(~is_system).join(system.select("s_conv", "fixed"), F.col("conv_id").eqNullSafe(F.col("s_conv")), "left")
    rows = rows.withColumn("fixed", F.coalesce("fixed", F.lit(0))).withColumn("a", F.col("a") - F.col("fixed"))
    rows = rows.withColumn("stride", F.lit(budget - history) - F.col("fixed"))
    last = F.floor((F.col("a") + F.col("size") - 1) / F.col("stride"))
    rows = rows.withColumn("cell", last).withColumn("across", F.floor(F.col("a") / F.col("stride")) < last)
    # Of each cell: the turn that reaches into it, and those within it.
    cells = rows.groupBy("conv_id", "cell").agg(
        F.first("stride").alias("stride"), F.first("fixed").alias("fixed"),
        *[F.sum(F.when(F.col("across") == x, F.col("size"))).alias(f"size{i}") for i, x in enumerate((True, False))],
        *[F.min(F.when(F.col("across") == x, F.col("a"))).alias(f"from{i}") for i, x in enumerate((True, False))],
    )
    one = (F.col("size0") + F.col("size1")) <= F.col("stride")
    span = lambda i, size, start: F.struct(F.lit(i).alias("half"), size.alias("new"), start.alias("start"))
    both = F.array(span(0, F.col("size0"), F.col("from0")), span(1, F.col("size1"), F.col("from1")))
    spans = cells.withColumn("one", F.coalesce(one, F.lit(False))).withColumn("h", F.explode(F.when(F.col("one"), F.array(span(0, F.col("size0") + F.col("size1"), F.col("from0")))).otherwise(F.filter(both, lambda x: x["new"].isNotNull()))))
    spans = spans.select("conv_id", "cell", "one", "stride", "fixed", "h.*")
    # The first span leaves the system turn a window of its own if they don't fit together.
    led = (F.col("fixed") > 0) & (F.col("new") + F.col("fixed") <= budget)
    in_order = Window.partitionBy("conv_id").orderBy("cell", "half")
    spans = spans.withColumn("led", led).withColumn("window", F.row_number().over(in_order)).withColumn("alone", F.first((F.col("fixed") > 0) & ~F.col("led")).over(in_order))
    spans = cut(spans.withColumn("window", F.col("window") + F.col("alone").cast("int")))
    halves = spans.select(F.col("conv_id").alias("h_conv"), F.col("cell").alias("h_cell"), F.col("half"), "one", "window")
    fresh = rows.join(halves, F.col("conv_id").eqNullSafe(F.col("h_conv")) & (F.col("cell") == F.col("h_cell")) & (F.col("one") | (F.col("across") == (F.col("half") == 0))))
    turn = lambda at, new, role, body, size: F.struct(at.alias("at"), new.alias("new"), role.alias("role"), body.alias("body"), size.alias("size"))
    placed = fresh.select("conv_id", "window", turn(F.col("at"), F.lit(True), F.col("role"), F.col("body"), F.col("size")).alias("t"))
    if history:
        # A turn is history of the spans that start at most `history` tokens after its own start: they share a bucket.
        later = spans.where((F.col("start") > 0) & (F.col("new") <= F.col("stride"))).select(F.col("conv_id").alias("l_conv"), F.floor(F.col("start") / history).alias("l_at"), "start", F.col("window").alias("l_window"))
        past = rows.where(F.col("size") <= history).withColumn("bucket", F.explode(F.sequence(F.floor((F.col("a") + F.col("size")) / history), F.floor((F.col("a") + history) / history))))
        again = past.join(later, F.col("conv_id").eqNullSafe(F.col("l_conv")) & (F.col("bucket") == F.col("l_at")) & (F.col("a") + F.col("size") <= F.col("start")) & (F.col("start") <= F.col("a") + history))
        placed = placed.union(again.select("conv_id", F.col("l_window").alias("window"), turn(F.col("at"), F.lit(False), F.col("role"), F.col("body"), F.col("size")).alias("t")))
    # The system turn is new in the first window, and leads the others that have room for it.
    heads = spans.where("led or (alone and window = 2)").select(F.col("conv_id").alias("l_conv"), F.when(F.col("led"), F.col("window")).otherwise(1).alias("l_window"))
    heads = system.join(heads, F.col("s_conv").eqNullSafe(F.col("l_conv")), "left").withColumn("w", F.coalesce("l_window", F.lit(1)))
    placed = placed.union(heads.select(F.col("s_conv").alias("conv_id"), F.col("w").alias("window"), turn(F.lit(1).cast("long"), F.col("w") == 1, F.col("s_role"), F.col("s_body"), F.col("fixed")).alias("t")))
    # A window holds few turns: each has a token at least.
    grouped = placed.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    head = lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(CLOSE))
    parts = F.transform("ts", lambda t: F.struct(head(t).alias("head"), escape(t["body"]).alias("body"), t["new"].alias("new"), (t["new"] & (t["role"] == target)).alias("loss")))
    grouped = grouped.withColumn("parts", parts)
    none = F.array().cast("array<struct<start:int,stop:int>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("spans"))

    def add(acc: Column, p: Column) -> Column:
        begin = acc["at"] + F.length(p["head"])
        end = begin + F.length(p["body"])
        own = F.when(p["loss"], F.array(F.struct(begin.alias("start"), end.alias("stop")))).otherwise(none)
        return F.struct((end + len(END)).alias("at"), F.concat(acc["spans"], own).alias("spans"))

    return grouped.select(
        "conv_id",
        F.col("window").cast("int").alias("window"),
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "").alias("text"),
        F.aggregate("ts", F.lit(0).cast("long"), lambda n, t: n + t["size"]).alias("tokens"),
        F.size(F.filter("parts", lambda p: ~p["new"])).alias("n_repeated"),
        F.aggregate("parts", start, add)["spans"].alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, window, turns of role and text that are new, targets under the mask, chars), all unescaped."""
    pieces = F.filter(F.split("text", END, -1), lambda x: F.length(x) > 0)  # END is no pattern but itself
    own = F.slice(pieces, F.col("n_repeated") + 1, F.greatest(F.size(pieces) - F.col("n_repeated"), F.lit(0)))
    close = lambda x: F.locate(CLOSE, x)
    turn = lambda x: F.struct(unescape(F.substring(x, F.lit(len(OPEN) + 1), close(x) - len(OPEN) - 1)).alias("role"), unescape(F.substring(x, close(x) + 1, F.length(x))).alias("text"))
    under = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("text"), s["start"] + 1, s["stop"] - s["start"])))
    return formatted.select("conv_id", "window", F.transform(own, turn).alias("turns"), under.alias("targets"), F.length("text").cast("long").alias("chars"))


def digests(formatted: DataFrame) -> DataFrame:
    """One row for each conversation, read back from its windows: counts and SHA-256 of turns and targets."""
    read = read_back(formatted)
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = read.select("conv_id", F.size("turns").cast("long").alias("n"), "chars", F.struct("window", told.alias("told"), F.array_join("targets", "").alias("loss")).alias("w"))
    # The digest of a conversation needs its whole text in order: here, and only here, one row has it.
    whole = rows.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.sort_array(F.collect_list("w")).alias("ws"))
    join = lambda name: F.array_join(F.transform("ws", lambda w: w[name]), "")
    return whole.select(
        "conv_id", "n_turns", F.sha2(join("told"), 256).alias("turns_sha256"), F.length(join("loss")).cast("long").alias("loss_chars"), F.sha2(join("loss"), 256).alias("loss_sha256"), "formatted_chars"
    )
