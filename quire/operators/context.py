"""References inside texts, and contexts put together for a language model within size limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as X

#: The tags of references, with a paragraph and without.
TAGGED = rf"(?i)\[R[éÉ]f:[{X.WS}]*([A-Za-z0-9_-]+),[{X.WS}]*Para\.[{X.WS}]*([0-9]+)[{X.WS}]*\]"
PLAIN = rf"(?i)\[R[éÉ]f:[{X.WS}]*([A-Za-z0-9_-]+)[{X.WS}]*\]"
#: Characters of the contexts.
CHAT_DOCUMENT, CHAT_ALL, STUDY_OTHER, STUDY_MAIN, STUDY_OTHERS, HISTORY = 15_000, 60_000, 8_000, 30_000, 3, 4
#: Parts in which the documents of a group are cut.
SALTS = 32
#: Fixed value: the header of a document.
HEAD = "[DOC ID: %s] - TITRE: %s (%s)\nCONTENU:\n"
EXTERNAL, SEPARATOR = "[[[NOTE_EXTERNE]]]", "\n\n---\n\n"


def references(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ref_no, ref_id, paragraph_index): the references with a paragraph in each text, in order."""
    rx = X.java(TAGGED)
    ids, paras = (F.regexp_extract_all(F.col(text), F.lit(rx), F.lit(g)) for g in (1, 2))
    rows = texts.select(key, F.posexplode(F.arrays_zip(ids.alias("i"), paras.alias("p"))).alias("n", "r"))
    return rows.select(key, (F.col("n") + 1).cast("long").alias("ref_no"), F.col("r.i").alias("ref_id"), F.col("r.p").try_cast("long").alias("paragraph_index"))


def plain_references(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ref_no, ref_id): the references without a paragraph."""
    rows = texts.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(X.java(PLAIN)), F.lit(1))).alias("n", "ref_id"))
    return rows.select(key, (F.col("n") + 1).cast("long").alias("ref_no"), "ref_id")


def resolved(refs: DataFrame, docs: DataFrame) -> DataFrame:
    """refs with known, and the title and date of the document where there is one.

    The first document of an id counts; only keys and titles are shuffled.
    """
    one = docs.groupBy(F.col("doc_id").alias("ref_id")).agg(F.min_by(F.struct("title", "sermon_date"), F.col("ord")).alias("d"))
    return refs.join(one, "ref_id", "left").select(*refs.columns, F.col("d").isNotNull().alias("known"), F.col("d.title").alias("title"), F.col("d.sermon_date").alias("sermon_date"))


def titles(refs: DataFrame, docs: DataFrame) -> DataFrame:
    """refs with label: the title in brackets, or the id where the document is unknown."""
    cols = refs.columns
    return resolved(refs, docs).select(*cols, F.concat(F.lit("["), F.when(F.col("known"), F.coalesce("title", F.lit(""))).otherwise(F.col("ref_id")), F.lit("]")).alias("label"))


def rich_content(citations: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, body): the quoted text; a link to the source document is put after it where the text has
    no known reference of its own, the source is known and isn't virtual."""
    own = resolved(plain_references(citations.select(F.col("id").alias("cid"), "quoted_text"), "cid", "quoted_text"), docs).filter("known").select(F.col("cid").alias("id")).distinct().withColumn("_has", F.lit(True))
    source = docs.groupBy(F.col("doc_id").alias("sermon_id")).agg(F.min_by("title", "ord").alias("_t"), F.lit(True).alias("_known"))
    rows = citations.select("id", "sermon_id", "quoted_text").join(own, "id", "left").join(source, "sermon_id", "left")
    virtual = F.col("sermon_id").contains("ia-") | F.col("sermon_id").contains("definition")
    tail = F.when(F.col("_has").isNull() & F.coalesce(F.col("_known"), F.lit(False)) & X.given(F.col("sermon_id")) & ~virtual, F.concat(F.lit(" [Source: "), F.coalesce("_t", F.lit("")), F.lit("]"))).otherwise("")
    return rows.select("id", F.concat(external(F.coalesce("quoted_text", F.lit(""))), tail).alias("body"))


def external(col: Column, note: str = "> **Note**\n\n>") -> Column:
    """The text with the marker of outside knowledge replaced."""
    return F.replace(col, F.lit(EXTERNAL), F.lit(note))


def numbered_text(text: Column) -> Column:
    """Each raw paragraph, blank ones too, as a line '[Para. n] …'."""
    lines = F.transform(X.paragraphs_of(text), lambda p, i: F.concat(F.lit("[Para. "), (i + 1).cast("string"), F.lit("] "), X.js_trim(p)))
    return F.array_join(lines, "\n")


def chat_context(docs: DataFrame, group: str, per_document: int = CHAT_DOCUMENT, whole: int = CHAT_ALL) -> DataFrame:
    """(group, context): of each group of documents their headers and numbered paragraphs, in order of ord.

    Each document is cut before it is gathered, and of a group only the documents that can reach
    into the limit are gathered, whatever its size.
    """
    head = F.format_string(HEAD, "doc_id", "title", "sermon_date")
    part = docs.filter(X.given(F.col("text"))).select(group, "ord", "doc_id", F.concat(head, F.substring(numbered_text(F.col("text")), 1, per_document)).alias("part"))
    return _joined(part, group, whole)


def _joined(part: DataFrame, group: str, whole: int) -> DataFrame:
    # more documents than this can't reach into the limit; a group of any size is cut to them in
    # SALTS parts of its rows before it is ordered as a whole
    most = whole // len(HEAD.replace("%s", "") + SEPARATOR) + 1
    order = ("ord", "doc_id")
    by_part = Window.partitionBy(group, "_salt").orderBy(*order)
    near = part.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).withColumn("_r", F.row_number().over(by_part)).filter(F.col("_r") <= most)
    before = F.sum(F.length("part") + len(SEPARATOR)).over(Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    near = near.withColumn("_before", F.coalesce(before, F.lit(0))).filter(F.col("_before") < whole)
    rows = F.array_sort(F.collect_list(F.struct("ord", "doc_id", "part")))
    return near.groupBy(group).agg(F.substring(F.array_join(F.transform(rows, lambda r: r["part"]), SEPARATOR), 1, whole).alias("context"))


def study_context(docs: DataFrame, chosen: DataFrame, main_id: str) -> DataFrame:
    """(doc_id, main, others): the main document's beginning, and the beginnings of the first other chosen documents in order of place.

    chosen is (doc_id, place).
    """
    others = docs.join(chosen.filter(F.col("doc_id") != main_id), "doc_id").orderBy("place").limit(STUDY_OTHERS)
    line = F.concat(F.lit("ID: "), "doc_id", F.lit(" | "), F.coalesce("title", F.lit("")), F.lit("\nCONTENU:\n"), F.substring(F.coalesce("text", F.lit("")), 1, STUDY_OTHER))
    parts = [r["part"] for r in others.select("place", line.alias("part")).orderBy("place").collect()]
    # STUDY_OTHERS short texts
    return docs.filter(F.col("doc_id") == main_id).select("doc_id", F.substring("text", 1, STUDY_MAIN).alias("main"), F.lit(SEPARATOR.join(parts)).alias("others"))


def last_messages(messages: DataFrame, most: int = HISTORY) -> DataFrame:
    """(chat_key, seq, role, content): the last messages of each chat, in order; 'assistant' becomes 'model', any other role 'user'."""
    w = Window.partitionBy("chat_key").orderBy(F.desc("seq"))
    kept = messages.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most)
    return kept.select("chat_key", "seq", F.when(F.col("role") == "assistant", "model").otherwise("user").alias("role"), "content")


def prompt(messages: DataFrame, current: DataFrame, most: int = HISTORY) -> DataFrame:
    """The last messages and after them the current one: current is (chat_key, seq, content), not yet among messages."""
    return last_messages(messages, most).unionByName(current.select("chat_key", "seq", F.lit("user").alias("role"), "content"))


def chat_key(ids: Column) -> Column:
    """The ids joined by commas, or 'global' without any."""
    return X.or_default(F.array_join(ids, ","), "global")


def web_sources(sources: Column, title: str = "Source Web") -> Column:
    """The sources that have an address, with a default title."""
    return F.transform(F.filter(sources, lambda s: s["uri"].isNotNull()), lambda s: F.struct(X.or_default(s["title"], title).alias("title"), s["uri"].alias("uri")))


def definitions(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """words with their definition by lower case, null where there is none; the latest entry of a word counts."""
    one = dictionary.groupBy(F.lower("word").alias("_w")).agg(F.max_by(F.struct("definition", "synonyms", "etymology"), "seq").alias("d"))
    return words.join(one, F.lower(words["word"]) == F.col("_w"), "left").select(words["word"], "d.definition", "d.synonyms", "d.etymology")


def definition_text(word: Column, definition: Column, etymology: Column, synonyms: Column, unknown: str = "Non spécifiée") -> Column:
    """A definition as the text of a citation."""
    return F.concat(F.lit("**"), word, F.lit("**\n\n"), definition, F.lit("\n\n*Étymologie :* "), X.or_default(etymology, unknown), F.lit("\n*Synonymes :* "), F.array_join(synonyms, ", "))


def selected_metadata(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents of a set of ids, each id once."""
    return docs.join(ids.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.max_by(F.struct("title", "sermon_date"), "ord").alias("d")).select("doc_id", "d.title", "d.sermon_date")


