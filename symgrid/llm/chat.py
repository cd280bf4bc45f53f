"""Chat formatting from event logs.

A log row is an event on a message: ``create`` (role, first text), ``delta`` (text to append),
``edit`` (text that replaces what there is), ``regenerate`` (starts the message anew and drops all
messages created after it so far) or ``delete`` (a later create, edit or regenerate starts the message
anew, at its new place). A conversation's events are sorted by sequence and folded into the messages
that are left, which are then rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def events_from_turns(turns: DataFrame) -> DataFrame:
    """A log of streamed, edited, regenerated and deleted messages that folds to the ``turns`` (conv_id, turn, role, text).

    Each turn is streamed line by line: its first line comes with an event of its own, each other
    line as a delta. By conversation and turn, that first event is a creation; or an edit or a
    regeneration of a draft that was created and streamed before, the latter with an answer to the
    draft that goes with it; or a creation beside a message that is created and deleted. Where a turn
    is there more than once, the texts are ordered; each after the first counts as an edit of the
    turn. Rows without conversation or turn are left out; a null text is empty.
    """
    own = turns.where("conv_id is not null and turn is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    w = Window.partitionBy("conv_id").orderBy("turn", F.col("role").asc_nulls_first(), "text")
    again = F.lag("turn").over(w).eqNullSafe(F.col("turn"))
    n = own.withColumns({"n": F.row_number().over(w).cast("long"), "again": again, "way": F.pmod(F.col("conv_id") * 3 + F.col("turn"), F.lit(4))})

    def event(kind: str | Column, of: int, text: Column, role: Column | None = None) -> Column:
        role = F.lit(None).cast("string") if role is None else role
        return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), F.lit(of).alias("of"), role.alias("role"), text.alias("text"))

    lines = F.split("text", "\n")
    start = lambda kind: event(kind, 0, lines[0], F.col("role"))
    draft = [event("create", 0, F.concat(F.lit("draft: "), F.reverse(lines[0])), F.col("role")), event("delta", 0, F.lit(" ..."))]
    before = F.when(F.col("again"), F.array(start("edit")))
    before = before.when(F.col("way") == 1, F.array(*draft, start("edit")))
    before = before.when(F.col("way") == 2, F.array(*draft, event("create", 1, F.lit("answer to the draft"), F.lit("user")), event("delta", 1, F.lit(", streamed")), start("regenerate")))
    before = before.when(F.col("way") == 3, F.array(event("create", 2, F.lit("by mistake"), F.lit("user")), start("create"), event("delete", 2, F.lit(""))))
    before = before.otherwise(F.array(start("create")))
    rest = F.transform(F.slice(lines, F.lit(2), F.size(lines)), lambda x: event("delta", 0, F.concat(F.lit("\n"), x)))
    e = n.select("conv_id", "turn", "n", F.posexplode(F.concat(before, rest)).alias("i", "e"))
    return e.select("conv_id", F.struct("n", "i").alias("seq"), (F.col("turn") * 3 + F.col("e.of")).alias("message_id"), "e.kind", "e.role", "e.text")


def fold_events(log: DataFrame) -> DataFrame:
    """``conv_id, at, role, text``: the messages left of each conversation; ``at`` orders them.

    ``log`` has ``conv_id, seq, message_id, kind, role, text``. One shuffle, by conversation.
    Events without conversation, sequence or message are left out; so are those of unknown kind. An
    event delivered twice (all columns equal) counts once. Ties in sequence are broken by kind
    (create, edit, regenerate, delta, delete), message and text. Null texts are empty. A message
    starts at its first event of any kind, after a deletion at the next that is no delta; its role is
    the first since then that is not null, else 'user'. A message that a regeneration dropped stays
    dropped unless it is deleted and starts anew. Very long texts are folded whole. Messages whose
    text ends up empty or blank are left out.
    """
    kinds = ("create", "edit", "regenerate", "delta", "delete")
    order = F.coalesce(*[F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(kinds)])
    own = log.where("conv_id is not null and seq is not null and message_id is not null").select("conv_id", "seq", "message_id", order.alias("k"), "role", F.coalesce("text", F.lit("")).alias("text")).where("k is not null")
    conv = Window.partitionBy("conv_id").orderBy("seq", "k", "message_id", F.col("role").asc_nulls_first(), "text")
    same = [F.lag(c).over(conv).eqNullSafe(F.col(c)) for c in ("seq", "k", "message_id", "role", "text")]
    twice = F.lag(F.lit(1)).over(conv).isNotNull()
    for s in same:
        twice = twice & s
    pos = own.withColumns({"pos": F.row_number().over(conv).cast("long"), "twice": twice}).where("not twice")
    msg = Window.partitionBy("conv_id", "message_id")
    # a message's life begins after its last deletion so far; the last life is the one that counts
    so_far = msg.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    pos = pos.withColumn("dead", F.max(F.when(F.col("k") == 4, F.col("pos"))).over(so_far))
    life = Window.partitionBy("conv_id", "message_id", "dead")
    pos = pos.withColumns({"start": F.min(F.when((F.col("k") < 3) | (F.col("dead").isNull() & (F.col("k") == 3)), F.col("pos"))).over(life), "gone": F.max(F.when(F.col("k") == 4, F.col("pos"))).over(msg)})
    pos = pos.withColumn("reset", F.max(F.when(F.col("k") < 3, F.col("pos"))).over(life))
    later = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    pos = pos.withColumn("cutoff", F.min(F.when(F.col("k") == 2, F.col("start"))).over(later))
    pos = pos.where("k < 4 and (gone is null or pos > gone) and pos >= start")
    parts = F.when(F.col("pos") >= F.coalesce("reset", F.lit(0)), F.struct("pos", "text"))
    m = pos.groupBy("conv_id", "message_id").agg(
        F.min("pos").alias("at"), F.min(F.when(F.col("role").isNotNull(), F.struct("pos", "role"))).alias("r"), F.min(F.when(F.col("pos") == F.col("start"), F.col("cutoff"))).alias("cutoff"), F.sort_array(F.collect_list(parts)).alias("parts")
    )
    m = m.where("cutoff is null or cutoff >= at")
    text = F.array_join(F.transform("parts", lambda p: p["text"]), "")
    return m.select("conv_id", "at", F.coalesce(F.col("r.role"), F.lit("user")).alias("role"), text.alias("text")).where(F.trim(F.translate("text", "\n\t\r", "   ")) != "")


def _escaped(text: Column) -> Column:
    """Marks within a text are broken up, so that it can't open or close a message."""
    return F.replace(F.replace(text, F.lit(OPEN), F.lit("<| im_start|>")), F.lit(CLOSE), F.lit("<| im_end|>"))


def render(messages: DataFrame) -> DataFrame:
    """``conv_id, n_messages, text``: the messages of each conversation between marks, in order.

    Marks within a text or role are broken up; line ends in a role are spaces.
    """
    role = _escaped(F.translate("role", "\n\r", "  "))
    one = F.concat(F.lit(OPEN), role, F.lit("\n"), _escaped(F.col("text")), F.lit(CLOSE), F.lit("\n"))
    g = messages.select("conv_id", F.struct("at", one.alias("m")).alias("m")).groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("m"))
    return g.select("conv_id", F.size("m").cast("long").alias("n_messages"), F.array_join(F.transform("m", lambda x: x["m"]), "").alias("text"))


def format_chats(log: DataFrame) -> DataFrame:
    """Fold and render. Conversations of which nothing is left have no row; an empty log gives none."""
    return render(fold_events(log))


SQL = f"""with t0 as (select conv_id, turn, role, coalesce(text, '') as text, row_number() over w as n, coalesce(lag(turn) over w = turn, false) as again from conversations where conv_id is not null and turn is not null
  window w as (partition by conv_id order by turn, role nulls first, text)),
ranked as (select *, row_number() over (partition by conv_id, turn order by n desc) as back from t0),
final as (select conv_id, turn, text, (select role from t0 z where z.conv_id = r.conv_id and z.turn = r.turn and z.role is not null order by z.n limit 1) as role, (select min(n) from t0 z where z.conv_id = r.conv_id and z.turn = r.turn) as pos from ranked r where back = 1),
kept as (select * from final where trim(translate(text, chr(10) || chr(9) || chr(13), '   ')) <> '')
select conv_id, count(*) as n_messages, string_agg('{OPEN}' || replace(replace(translate(coalesce(role, 'user'), chr(10) || chr(13), '  '), '{OPEN}', '<| im_start|>'), '{CLOSE}', '<| im_end|>') || chr(10) || replace(replace(text, '{OPEN}', '<| im_start|>'), '{CLOSE}', '<| im_end|>') || '{CLOSE}' || chr(10), '' order by pos) as text from kept group by conv_id"""
