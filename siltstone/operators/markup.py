"""Regions and nesting of marked-up text, by scans that a single large text can share
among tasks.

A text is cut before every ``<``. Each piece is a function from the state that it is
entered in (in text, in a tag, in a comment, ...) to the one it leaves; functions of a
block of pieces are composed, then those of the blocks of a text, and so every piece
learns its state without any task having to read all pieces before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pieces in a block.
BLOCK = 1024
#: Elements whose content is text until their own end tag.
RAW = ("script", "style")
#: Elements without content (fixed values).
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
COMMENT = ("<!--", "-->")
#: States: outside of everything, right after a region; in a tag; in a comment; in text
#: that has begun. Raw element k adds 4 + 2k (in its start tag) and 5 + 2k (in it).
_EDGE, _TAG, _COMMENT, _TEXT = 0, 1, 2, 3
_BITS = 4
#: What a piece starts with: nothing, a comment, a tag; 10 + k, 20 + k: start and end tag
#: of raw element k.
_PLAIN, _OPENS, _TAGGED = 0, 1, 2


def pieces_of(texts: DataFrame, *, id_col: str, text_col: str, raw: tuple[str, ...] = RAW, comment: tuple[str, str] = COMMENT, block: int = BLOCK) -> DataFrame:
    """row, id, block, pos, n (characters), mark, name, ends (closing tag), void, and
    where the first > and the first end of a comment are behind (0: nowhere)."""
    if len(raw) > 6 or block < 1:
        raise ValueError("at most six raw elements, at least one piece in a block")
    opens, closes = comment
    rows = texts.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.split(F.coalesce(F.col(text_col), F.lit("")), "(?=<)").alias("p"))
    rows = rows.select("row", "id", F.posexplode("p").alias("pos", "p"))
    p = F.col("p")
    behind = lambda mark, start: F.when(F.locate(mark, p, start) > 0, F.locate(mark, p, start) + len(mark) - 1).otherwise(0)
    mark = F.when(p.startswith(opens), _OPENS)
    for k, name in enumerate(raw):
        mark = mark.when(p.rlike(f"(?i)^<{name}([^A-Za-z0-9]|$)"), 10 + k).when(p.rlike(f"(?i)^</{name}([^A-Za-z0-9]|$)"), 20 + k)
    e1 = behind(">", 1)
    return rows.select(
        "row", "id", F.floor(F.col("pos") / block).cast("int").alias("block"), "pos", F.length(p).alias("n"),
        mark.when(p.rlike("^<[A-Za-z/!?]"), _TAGGED).otherwise(_PLAIN).alias("mark"),
        F.lower(F.regexp_extract(p, "^</?([A-Za-z][A-Za-z0-9:-]*)", 1)).alias("name"), p.startswith("</").alias("ends"),
        e1.alias("e1"), behind(closes, len(opens) + 1).alias("e2"), behind(closes, 1).alias("e3"), (F.substr(p, e1 - 1, F.lit(2)) == "/>").alias("empty"),
    )


def _parts(s: str, raws: int) -> dict[str, str]:
    """SQL for what a piece is, entered in state ``s`` (an expression): the state of its
    first part, whether that part begins here, its length if it ends here (else null),
    and the state that follows it."""
    text = f"{s} in ({_EDGE}, {_TEXT})"
    raw_of = [(k, 4 + 2 * k, 5 + 2 * k) for k in range(raws)]
    first = f"case when {text} then case mark when {_PLAIN} then {_TEXT} when {_OPENS} then {_COMMENT} " + "".join(f"when {10 + k} then {a} " for k, a, _ in raw_of) + f"else {_TAG} end "
    first += "".join(f"when {s} = {b} and mark = {20 + k} then {_TAG} " for k, _, b in raw_of) + f"else {s} end"
    begins = f"({s} = {_EDGE} or {s} = {_TEXT} and mark <> {_PLAIN}" + "".join(f" or {s} = {b} and mark = {20 + k}" for k, _, b in raw_of) + ")"
    stays = f"{text} and mark = {_PLAIN}" + "".join(f" or {s} = {b} and mark <> {20 + k}" for k, _, b in raw_of)
    cut = f"case when {stays} then null when {text} and mark = {_OPENS} then nullif(e2, 0) when {s} = {_COMMENT} then nullif(e3, 0) else nullif(e1, 0) end"
    then = f"case ({first}) " + "".join(f"when {a} then {b} " for _, a, b in raw_of) + f"else case when n > {cut} then {_TEXT} else {_EDGE} end end"
    return {"first": first, "begins": begins, "cut": cut, "then": then}


def _function(raws: int) -> str:
    """A piece as a function: the state it leaves for each state, in four bits each."""
    each = []
    for s in range(4 + 2 * raws):
        p = _parts(str(s), raws)
        left = f"case when n = 0 then {s} when {p['cut']} is null then {p['first']} else {p['then']} end"
        each.append(f"shiftleft(cast({left} as bigint), {_BITS * s})")
    return " | ".join(each)


def _composed(raws: int, x: str) -> str:
    """The function ``acc`` and then the function ``x``."""
    at = lambda f, s: f"(shiftrightunsigned({f}, {s}) & 15)"
    return " | ".join(f"shiftleft({at(x, f'cast({_BITS} * {at("acc", _BITS * s)} as int)')}, {_BITS * s})" for s in range(4 + 2 * raws))


def scanned(texts: DataFrame, *, id_col: str, text_col: str, raw: tuple[str, ...] = RAW, comment: tuple[str, str] = COMMENT, block: int = BLOCK) -> DataFrame:
    """The pieces, each with ``state``, the one it is entered in, and ``at``, its place."""
    raws = len(raw)
    found = pieces_of(texts, id_col=id_col, text_col=text_col, raw=raw, comment=comment, block=block).withColumn("f", F.expr(_function(raws)))
    held = F.sort_array(F.collect_list(F.struct("pos", "f", "n", "mark", "name", "ends", "e1", "e2", "e3", "empty")))
    blocks = found.groupBy("row", "block").agg(F.first("id").alias("id"), held.alias("p"))
    identity = sum(s << (_BITS * s) for s in range(4 + 2 * raws))
    whole = F.expr(f"aggregate(p, {identity}L, (acc, x) -> {_composed(raws, 'x.f')})")
    facts = blocks.select("row", "block", whole.alias("g"), F.expr("aggregate(p, 0L, (acc, x) -> acc + x.n)").alias("chars"))
    # The blocks of a text in order: one character for the state that each is entered in.
    step = f"named_struct('s', shiftrightunsigned(x.g, cast({_BITS} * acc.s as int)) & 15, 't', concat(acc.t, lower(hex(acc.s))))"
    states = facts.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("block", "g", "chars"))).alias("b"))
    states = states.select("row", "b", F.expr(f"aggregate(b, named_struct('s', 0L, 't', ''), (acc, x) -> {step}).t").alias("t"))
    entered = states.select("row", F.col("t"), F.posexplode("b").alias("i", "b")).select("row", "b.block", F.conv(F.substr("t", F.col("i") + 1, F.lit(1)), 16, 10).cast("long").alias("s0"), "b.chars")
    ahead = Window.partitionBy("row").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    entered = entered.select("row", "block", "s0", F.coalesce(F.sum("chars").over(ahead), F.lit(0)).alias("at0"))
    # And the pieces of a block, from that state on.
    step = f"named_struct('s', shiftrightunsigned(x.f, cast({_BITS} * acc.s as int)) & 15, 't', concat(acc.t, lower(hex(acc.s))))"
    known = blocks.join(entered, ["row", "block"]).select("row", "block", "id", "at0", "p", F.expr(f"aggregate(p, named_struct('s', s0, 't', ''), (acc, x) -> {step}).t").alias("t"))
    each = known.select("row", "block", "id", "at0", "t", F.posexplode("p").alias("i", "p"))
    upto = Window.partitionBy("row", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    state = F.conv(F.substr("t", F.col("i") + 1, F.lit(1)), 16, 10).cast("int").alias("state")
    return each.select("row", "block", "id", "at0", state, "p.*").withColumn("at", F.col("at0") + F.coalesce(F.sum("n").over(upto), F.lit(0))).drop("at0", "f")


def regions(texts: DataFrame, *, id_col: str, text_col: str, raw: tuple[str, ...] = RAW, comment: tuple[str, str] = COMMENT, block: int = BLOCK) -> DataFrame:
    """Per text and kind (text, tag, comment and the raw elements): id, kind, pieces
    (regions that begin) and chars. A tag ends at the first >, a comment at the first of
    its end marks; what isn't closed goes on to the end. Kinds that a text doesn't have
    give no row, and so do null and empty texts. Null and repeated ids are texts of
    their own."""
    raws = len(raw)
    p = _parts("state", raws)
    kinds = {_EDGE: "text", _TEXT: "text", _TAG: "tag", _COMMENT: "comment"} | {4 + 2 * k: "tag" for k in range(raws)} | {5 + 2 * k: raw[k] for k in range(raws)}
    kind = lambda c: F.element_at(F.array(*[F.lit(kinds[s]) for s in range(4 + 2 * raws)]), c + 1)
    cut = scanned(texts, id_col=id_col, text_col=text_col, raw=raw, comment=comment, block=block).where("n > 0").select("row", "id", "n", F.expr(p["first"]).alias("first"), F.expr(p["begins"]).alias("begins"), F.expr(p["cut"]).alias("cut"), F.expr(p["then"]).alias("then"))
    one = F.struct(kind(F.col("first")).alias("kind"), F.coalesce("cut", "n").alias("chars"), F.col("begins").alias("new"))
    # A raw element begins with the end of its start tag, even if it is empty.
    two = F.struct(kind(F.col("then")).alias("kind"), (F.col("n") - F.col("cut")).alias("chars"), F.lit(True).alias("new"))
    more = F.col("cut").isNotNull() & (F.col("then") != _EDGE)
    each = cut.select("row", "id", F.explode(F.when(more, F.array(one, two)).otherwise(F.array(one))).alias("x"))
    return each.groupBy("row", "id", "x.kind").agg(F.count_if("x.new").alias("pieces"), F.sum("x.chars").cast("long").alias("chars")).select("id", "kind", "pieces", "chars")


def tags(texts: DataFrame, *, id_col: str, text_col: str, raw: tuple[str, ...] = RAW, comment: tuple[str, str] = COMMENT, void: tuple[str, ...] = VOID, block: int = BLOCK) -> DataFrame:
    """row, id, name, at, opens of each tag of an element that has content; one row with
    a null name for each other piece, so that no text is lost."""
    found = scanned(texts, id_col=id_col, text_col=text_col, raw=raw, comment=comment, block=block)
    starts = F.col("state").isin(_EDGE, _TEXT) & (F.col("mark") >= _TAGGED)
    for k in range(len(raw)):
        starts = starts | (F.col("state") == 5 + 2 * k) & (F.col("mark") == 20 + k)
    counts = starts & (F.col("name") != "") & ~F.col("name").isin(*void) & ~F.col("empty")
    return found.select("row", "id", F.when(counts, F.col("name")).alias("name"), "at", (~F.col("ends")).alias("opens"))


def matched(found: DataFrame) -> DataFrame:
    """Tags with ``partner``, the place of the tag that closes an opening one, and
    ``closed``, for both of a pair.

    With +1 for each opening and -1 for each closing tag of a name, prefix sums give the
    level that a tag leads to or from; the tags of one level open and close by turns, so
    a tag's partner is its neighbour in the order of its level."""
    order = Window.partitionBy("row", "name").orderBy("at")
    depth = F.sum(F.when(F.col("opens"), 1).otherwise(-1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    level = Window.partitionBy("row", "name", "level").orderBy("at")
    leveled = found.withColumn("level", depth - F.when(F.col("opens"), 1).otherwise(0))
    both = leveled.select("*", F.lead("at").over(level).alias("next"), F.lag("at").over(level).alias("last"))
    partner = F.when(F.col("opens"), F.col("next"))
    return both.select("row", "id", "name", "at", "opens", partner.alias("partner"), F.coalesce(partner, F.when(~F.col("opens"), F.col("last"))).isNotNull().alias("closed"))


def _depths(found: DataFrame) -> DataFrame:
    order = Window.partitionBy("row").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return found.withColumn("depth", F.sum(F.when(~F.col("closed"), 0).when(F.col("opens"), 1).otherwise(-1)).over(order))


def nesting(texts: DataFrame, **options) -> DataFrame:
    """Per text: id, max_depth (most closed elements around one place), n_elements
    (opening tags), n_unclosed (those without a closing tag), n_unopened (closing tags
    without an opening one). Null and empty texts have zeros."""
    found = tags(texts, **options)
    named = _depths(matched(found.where("name is not null")))
    own = named.groupBy("row").agg(F.max("depth").alias("max_depth"), F.count_if("opens").alias("n_elements"), F.count_if(F.expr("opens and not closed")).alias("n_unclosed"), F.count_if(F.expr("not opens and not closed")).alias("n_unopened"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return found.select("row", "id").distinct().join(own, "row", "left").select("id", *map(zero, ("max_depth", "n_elements", "n_unclosed", "n_unopened")))


def blocks(texts: DataFrame, **options) -> DataFrame:
    """Per closed element: id, name, start, end (characters: where its opening and its
    closing tag start), depth."""
    named = _depths(matched(tags(texts, **options).where("name is not null")))
    return named.where("opens and closed").select("id", "name", F.col("at").alias("start"), F.col("partner").alias("end"), F.col("depth").cast("long").alias("depth"))
