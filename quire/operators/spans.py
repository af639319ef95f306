"""Tokens of documents, places of matches in them, and what tokens a span covers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as X

#: Quotes that one copy of a document is searched for.
QUOTES = 2_000
#: Characters of a bin by which spans and tokens meet.
BIN = 1024
#: Tokens of a part in which coloured() counts.
PART = 64
#: X.TOKEN with blanks and the common letters and signs tried first, several times as fast.
TOKEN = f"(?: ++|[{X.WS}]++)++|(?:[!-~À-ɏ]++|[^{X.WS}]++)++"


def tokens(docs: DataFrame, separator: str = X.BLANK_LINE) -> DataFrame:
    """(doc_id, segment_index, global_index, token): words and white space of each paragraph.

    The index runs over the whole document; paragraph separators are no tokens. One generator a
    row numbers them, so there is no shuffle.
    """
    segments = X.paragraphs_of(F.col("text"), separator)
    nested = F.flatten(F.transform(segments, lambda s, i: F.transform(X.tokens_of(s), lambda t: F.struct(i.alias("i"), t.alias("t")))))
    rows = docs.select("doc_id", F.posexplode(nested).alias("g", "x"))
    return rows.select("doc_id", F.col("x.i").cast("long").alias("segment_index"), F.col("g").cast("long").alias("global_index"), F.col("x.t").alias("token"))


def glued(docs: DataFrame, separator: str = X.BLANK_LINE) -> Column:
    """The text that tokens make up: paragraphs joined with nothing between, so matches may straddle them."""
    return F.regexp_replace(F.col("text"), separator, "")


def with_offsets(toks: DataFrame) -> DataFrame:
    """toks with start and end of each token in the glued text.

    Tokens of documents that are already distributed by key, as those of ingest.dedupe, aren't shuffled.
    """
    w = Window.partitionBy("doc_id").orderBy("global_index")
    end = F.sum(F.length("token")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return toks.withColumn("end", end).withColumn("start", F.col("end") - F.length("token"))


def matching(docs: DataFrame, pattern: str) -> DataFrame:
    """The documents with a match in their glued text; only their tokens are needed to decorate matches."""
    return docs.filter(glued(docs).rlike(X.java(pattern)))


def match_spans(docs: DataFrame, pattern: str, text: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, keep…, match_no, start, end, match): every match of a pattern in a text, the glued one unless another is given.

    start and end are sums within a row, without a shuffle.
    """
    body = glued(docs) if text is None else text
    found = X.match_structs(body, pattern)
    held = docs.filter(body.rlike(X.java(pattern))).select("doc_id", *keep, found.alias("f"))
    ends = X.running(F.transform("f", lambda x: (F.length(x["piece"]) + F.length(x["match"])).cast("long")), True)
    rows = held.select("doc_id", *keep, F.posexplode(F.arrays_zip(ends.alias("end"), F.col("f"))).alias("n", "m"))
    return rows.select("doc_id", *keep, (F.col("n") + 1).cast("long").alias("match_no"), (F.col("m.end") - F.length("m.f.match")).alias("start"), F.col("m.end").alias("end"), F.col("m.f.match").alias("match"))


def overlaps(toks: DataFrame, spans: DataFrame) -> DataFrame:
    """Tokens with the spans of their document that they overlap: token end > span start and token start < span end.

    Both sides are cut into bins of the text and meet by document and bin, so a long document with
    many spans isn't compared all with all; a pair that shares several bins comes out of the first.
    """
    bins = lambda a, b: F.sequence(F.floor(F.col(a) / BIN), F.floor((F.greatest(F.col(b) - 1, F.col(a))) / BIN))
    left = toks.withColumn("_bin", F.explode(bins("start", "end")))
    cols = [c for c in spans.columns if c not in ("doc_id", "start", "end")]
    right = spans.select("doc_id", *cols, F.col("start").alias("span_start"), F.col("end").alias("span_end"), F.explode(bins("start", "end")).alias("_bin"))
    met = left.join(right, ["doc_id", "_bin"]).filter((F.col("end") > F.col("span_start")) & (F.col("start") < F.col("span_end")))
    return met.filter(F.col("_bin") == F.floor(F.greatest("start", "span_start") / BIN)).drop("_bin")


def first_token_after(toks: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, match_no, global_index): the first token that starts at or after each match; a match within the last token gives none.

    An as-of merge: tokens and matches of a document in one descending order, each match taking the
    token last seen.
    """
    events = toks.select("doc_id", F.col("start").alias("at"), F.lit(1).alias("is_token"), F.col("global_index"), F.lit(None).cast("long").alias("match_no"))
    events = events.unionByName(spans.select("doc_id", F.col("start").alias("at"), F.lit(0).alias("is_token"), F.lit(None).cast("long").alias("global_index"), "match_no"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("at"), F.desc("is_token"), F.desc("global_index")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn("next", F.last("global_index", True).over(w)).filter("is_token = 0 and next is not null").select("doc_id", "match_no", F.col("next").alias("global_index"))


def highlight_tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, global_index, highlight_id, color): the tokens of each highlight, both ends included; a later one wins."""
    each = docs.select("doc_id", F.posexplode("highlights").alias("n", "h")).filter("h.first_tok is not null and h.last_tok >= h.first_tok")
    rows = each.select("doc_id", F.explode(F.sequence(F.col("h.first_tok"), F.col("h.last_tok"))).alias("g"), "n", F.col("h.id").alias("highlight_id"), F.col("h.color").alias("color"))
    return rows.groupBy("doc_id", F.col("g").cast("long").alias("global_index")).agg(F.max_by(F.struct("highlight_id", "color"), F.col("n")).alias("h")).select("doc_id", "global_index", "h.highlight_id", "h.color")


def word_colours(toks: DataFrame, highlights: DataFrame, found: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """(doc_id, global_index, color): 'selection' before the highlight's colour (amber without one) before amber for a found token; uncoloured tokens are left out."""
    cols = ["doc_id", "global_index"]
    marks = highlights.select(*cols, F.lit(2).alias("rank"), X.or_default(F.col("color"), "amber").alias("color"))
    marks = marks.unionByName(found.select(*cols, F.lit(1).alias("rank"), F.lit("amber").alias("color")))
    if selected is not None:
        marks = marks.unionByName(selected.select(*cols, F.lit(3).alias("rank"), F.lit("selection").alias("color")))
    best = marks.groupBy(*cols).agg(F.max_by("color", "rank").alias("color"))
    return toks.select(*cols).join(best, cols)


def _bound(value: Column, use) -> Column:
    """use(value), the value computed once however often use names it."""
    return F.transform(F.array(value), use)[0]


def _below(values: Column, wanted: Column) -> Column:
    """How many of the ascending values are less than wanted, by halving, in as many steps as their number has bits."""

    def step(a: Column, _: Column) -> Column:
        mid = F.shiftright(a["lo"] + a["hi"], 1)
        upper, lower = F.struct((mid + 1).alias("lo"), a["hi"].alias("hi")), F.struct(a["lo"].alias("lo"), mid.alias("hi"))
        return F.when(a["lo"] >= a["hi"], a).when(F.get(values, mid) < wanted, upper).otherwise(lower)

    return F.aggregate(F.sequence(F.lit(1), F.length(F.bin(F.size(values)))), F.struct(F.lit(0).alias("lo"), F.size(values).alias("hi")), step)["lo"]


def _count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))).cast("long")


def _parts(text: Column, separator: str) -> Column:
    """struct(part, end, first, n): the parts of PART tokens of each paragraph, where they end in the glued text, the index of their first token, and the number of all tokens."""

    def of_paragraph(s: Column) -> Column:
        cut = F.regexp_extract_all(s, F.lit(f"(?:{TOKEN}){{1,{PART}}}"), F.lit(0))
        # only the last one can hold fewer
        return _bound(cut, lambda p: F.transform(p, lambda t, i: F.struct(t.alias("text"), F.when(i < F.size(p) - 1, F.lit(PART).cast("long")).otherwise(_count(t)).alias("n"))))

    def summed(p: Column) -> Column:
        size, n = F.transform(p, lambda x: F.length(x["text"]).cast("long")), F.transform(p, lambda x: x["n"])
        end, first = _bound(size, lambda v: X.running(v, True)), _bound(n, lambda v: X.running(v))
        total = F.aggregate(p, F.lit(0).cast("long"), lambda a, x: a + x["n"])
        return F.struct(p.alias("part"), end.alias("end"), first.alias("first"), total.alias("n"))

    return _bound(F.flatten(F.transform(X.paragraphs_of(text, separator), of_paragraph)), summed)


def _token_at(parts: Column, at: Column) -> Column:
    """The index of the token that holds a character of the glued text: those before its part and those up to it in its part."""

    def of(i: Column) -> Column:
        text, first = F.get(parts["part"], i)["text"], F.get(parts["first"], i)
        upto = at + 1 - (F.get(parts["end"], i) - F.length(text))
        # a paragraph without white space may be very long
        single = (F.get(parts["part"], i)["n"] == 1) & (at >= 0)
        return F.when(single, first).otherwise(first + _count(text.substr(F.lit(1), upto.cast("int"))) - 1)

    return _bound(_below(parts["end"], at + 1), of)


def coloured(docs: DataFrame, pattern: str, separator: str = X.BLANK_LINE) -> DataFrame:
    """(doc_id, global_index, color): word_colours of the highlights and of the matches of a pattern in the glued text.

    Documents are read once, and only tokens that have a colour become rows: a match counts tokens in
    the parts of its first and its last character, a highlight ends with the document at the latest.
    Documents that are already distributed by key, as those of ingest.dedupe, aren't shuffled.
    """
    body = glued(docs, separator)
    ends = lambda f: _bound(F.transform(f, lambda x: (F.length(x["piece"]) + F.length(x["match"])).cast("long")), lambda n: X.running(n, True))
    structs = _bound(body, lambda b: X.match_structs(b, pattern))
    matches = _bound(structs, lambda f: F.zip_with(ends(f), f, lambda e, x: F.struct((e - F.length(x["match"])).alias("start"), e.alias("end"))))
    marks = F.filter("highlights", lambda h: h["first_tok"].isNotNull() & (h["last_tok"] >= h["first_tok"]))

    def spans(parts: Column) -> Column:
        one = lambda a, b, rank, color: F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"), rank.alias("rank"), color.alias("color"))
        found = F.transform(matches, lambda m: one(_token_at(parts, m["start"]), _token_at(parts, m["end"] - 1), F.lit(0), F.lit("amber")))
        # a later highlight wins
        marked = F.transform(marks, lambda h, i: one(F.greatest(h["first_tok"], F.lit(0)), F.when(h["last_tok"] < parts["n"], h["last_tok"]).otherwise(parts["n"] - 1), i + 1, X.or_default(h["color"], "amber")))
        none = F.array().cast("array<struct<a:bigint,b:bigint,rank:int,color:string>>")
        return F.concat(F.coalesce(found, none), F.coalesce(marked, none))

    held = docs.filter((F.size("highlights") > 0) | body.rlike(X.java(pattern)))
    rows = held.select("doc_id", F.explode(_bound(_parts(F.col("text"), separator), spans)).alias("s")).filter("s.a <= s.b")
    each = rows.select("doc_id", F.explode(F.sequence("s.a", "s.b")).alias("global_index"), "s.rank", "s.color")
    return each.groupBy("doc_id", "global_index").agg(F.max_by("color", "rank").alias("color"))


def decorated(*parts: DataFrame) -> DataFrame:
    """(doc_id, global_index): the tokens that any part marks, once."""
    out = parts[0].select("doc_id", "global_index")
    for p in parts[1:]:
        out = out.unionByName(p.select("doc_id", "global_index"))
    return out.distinct()


def paragraph_jump(toks: DataFrame, paragraph_index: int, pattern: str | None = None) -> DataFrame:
    """(doc_id, global_index): in one paragraph of each document the tokens of the first match, or all of them without a match."""
    inside = toks.filter(F.col("segment_index") == paragraph_index - 1)
    if pattern is None:
        return inside.select("doc_id", "global_index")
    # a paragraph's tokens, as many as its length allows
    para = inside.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("global_index", "token"))).alias("t"))
    text = F.array_join(F.transform("t", lambda x: x["token"]), "")
    start = X.first_place(text, pattern)
    end = start + F.length(F.regexp_extract(text, X.java(pattern), 0))
    w = Window.partitionBy("doc_id").orderBy("global_index")
    rows = para.select("doc_id", start.alias("ms"), end.alias("me"), F.explode("t").alias("x")).select("doc_id", "ms", "me", "x.*")
    rows = rows.withColumn("e", F.sum(F.length("token")).over(w)).withColumn("s", F.col("e") - F.length("token"))
    return rows.filter("ms is null or (e > ms and s < me)").select("doc_id", "global_index")


def add_highlight(highlights: Column, id_: str, a: int, b: int, color: str = "amber") -> Column:
    """highlights with one more, from the smaller to the larger end."""
    kind = "array<struct<id:string,first_tok:int,last_tok:int,color:string>>"
    one = F.struct(F.lit(id_).alias("id"), F.lit(min(a, b)).alias("first_tok"), F.lit(max(a, b)).alias("last_tok"), F.lit(color).alias("color"))
    return F.concat(F.coalesce(highlights, F.array().cast(kind)), F.array(one).cast(kind))


def remove_highlight(highlights: Column, id_: str) -> Column:
    """highlights without the one of that id."""
    return F.filter(highlights, lambda h: ~F.coalesce(h["id"] == id_, F.lit(False)))


def quote_locations(docs: DataFrame, quotes: DataFrame) -> DataFrame:
    """(quote_id, doc_id, start): every place, counted from 0, where a quote stands in its document's glued text, word for word.

    quotes has quote_id, doc_id, quote. Documents meet their quotes by key, QUOTES of them at a
    time, so a document that is quoted very often is spread over the tasks. A document is read
    once for all quotes of a part, by an automaton of them, instead of once for each; places of
    one quote don't overlap, the leftmost count.
    """
    q = quotes.filter(F.length("quote") > 0).select("quote_id", "doc_id", "quote").distinct()
    parts = q.groupBy("doc_id").agg(F.ceil(F.count("*") / QUOTES).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("quote_id", "quote"), F.col("parts")).cast("int")
    # about QUOTES quotes a row
    asked = q.join(parts, "doc_id").groupBy("doc_id", part.alias("part")).agg(F.collect_list(F.struct("quote_id", "quote")).alias("asked"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = asked.join(docs.select("doc_id", glued(docs).alias("body")), "doc_id").repartition(n, "doc_id", "part").select("doc_id", "body", "asked")
    kinds = {f.name: f.dataType.simpleString() for f in quotes.schema}
    return both.filter("body is not null").mapInArrow(_find_quotes, f"quote_id {kinds['quote_id']}, doc_id {kinds['doc_id']}, start bigint")


def _find_quotes(batches):
    import ahocorasick
    import pyarrow as pa

    for b in batches:
        for k in range(b.num_rows):
            doc_id, body, asked = (b.column(i)[k].as_py() for i in range(3))
            ids: dict[str, list] = {}
            for x in asked:
                ids.setdefault(x["quote"], []).append(x["quote_id"])
            machine = ahocorasick.Automaton()
            for text in ids:
                machine.add_word(text, text)
            machine.make_automaton()
            free: dict[str, int] = {}
            out: list[tuple] = []
            for end, text in machine.iter(body):
                start = end - len(text) + 1
                if start >= free.get(text, 0):
                    free[text] = end + 1
                    out += [(i, start) for i in ids[text]]
            found = pa.array([i for i, _ in out], b.schema.field(2).type.value_type.field(0).type)
            yield pa.RecordBatch.from_arrays([found, pa.array([doc_id] * len(out), b.schema.field(0).type), pa.array([s for _, s in out], pa.int64())], names=["quote_id", "doc_id", "start"])


def quote_spans(docs: DataFrame, quotes: DataFrame) -> DataFrame:
    """(quote_id, doc_id, start, end) of every place of the quotes in the glued texts of their documents."""
    size = quotes.select("quote_id", "doc_id", F.length("quote").alias("_n")).distinct()
    found = quote_locations(docs, quotes).join(size, ["quote_id", "doc_id"])
    return found.select("quote_id", "doc_id", "start", (F.col("start") + F.col("_n")).alias("end"))


def citation_colours(docs: DataFrame, toks: DataFrame, citations: DataFrame, notes: DataFrame, default: str = "default") -> DataFrame:
    """(note_id, doc_id, global_index, color): the tokens that the citations of each note cover, in the note's colour.

    toks has offsets. A citation's text is looked for in its document word for word.
    """
    held = citations.filter(X.given(F.col("quoted_text"))).select("note_id", F.col("id").alias("quote_id"), F.col("sermon_id").alias("doc_id"), F.col("quoted_text").alias("quote"))
    covered = overlaps(toks, quote_spans(docs, held)).select("doc_id", "quote_id", "global_index")
    colour = notes.groupBy(F.col("id").alias("note_id")).agg(F.min(X.or_default(F.col("color"), default)).alias("color"))
    return covered.join(held.select("quote_id", "note_id").distinct(), "quote_id").join(colour, "note_id").select("note_id", "doc_id", "global_index", "color").distinct()


def first_quote_tokens(docs: DataFrame, toks: DataFrame, quotes: DataFrame) -> DataFrame:
    """(quote_id, doc_id, global_index): the tokens of the first place of each quote."""
    first = quote_spans(docs, quotes).groupBy("quote_id", "doc_id").agg(F.min("start").alias("start"), F.min("end").alias("end"))
    return overlaps(toks, first).select("quote_id", "doc_id", "global_index")
