"""Documents: personal data, evidence, topics, retrieval, html bodies, duplicate survivors."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from offerlens.functions import text

# Patterns of personal data.
PERSONAL = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "iban": r"\bTR\d{2}[ ]?(?:\d{4}[ ]?){5}\d{2}\b",
    "mobile": r"(?<!\d)(?:\+90|0)?[ ]?5\d{2}[ ]?\d{3}[ ]?\d{2}[ ]?\d{2}(?!\d)",
    "national_id": r"(?<!\d)[1-9]\d{10}(?!\d)",
}


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kind, masked, hits): personal data by kind, masked; national ids only with a valid checksum."""
    found = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_extract_all(text_col, F.lit(f"({p})"), 1).alias("values")) for k, p in PERSONAL.items()])
    rows = docs.select(F.col(id_col).alias("doc_id"), F.inline(found)).select("doc_id", "kind", F.explode("values").alias("value"))
    valid = (F.col("kind") != "national_id") | text.national_id_valid(F.col("value"))
    return rows.where(valid).groupBy("doc_id", "kind", text.masked(F.col("kind"), F.col("value")).alias("masked")).agg(F.count(F.lit(1)).alias("hits"))


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 40) -> DataFrame:
    """(doc_id, pos, chunk): lines of at least so many characters, numbered among those kept."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(text.paragraphs(F.col(text_col), least)).alias("pos", "chunk"))


def containments(items: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, doc_id): documents that hold an item's text word for word.

    A held text brings its inner words along whole, so both sides are keyed by the first inner words of an item, up to
    four, and only documents with the same words at some place are searched.  Items of fewer than three words have no
    inner word; they are held against every document.  Null texts are not looked for.
    """
    word = r"(?<!\S)(?=(\S+(?:\s+\S+){%d}))"
    quotes = items.select("item_id", F.col("text").alias("quote"), F.size(F.regexp_extract_all(F.trim("text"), F.lit(r"(\S+)"), 1)).alias("words"))
    quotes = quotes.where("quote IS NOT NULL").withColumn("n", F.greatest(F.lit(0), F.least(F.col("words") - 2, F.lit(4))))
    used = {r["n"] for r in quotes.select("n").distinct().collect()}  # five at most
    short = docs.join(quotes.where("n = 0"), F.contains(docs["text"], F.col("quote"))).select("item_id", "doc_id")
    if used <= {0}:
        return short
    quotes = quotes.where("n > 0")
    inner = reduce(lambda out, n: F.when(F.col("n") == n, F.regexp_extract("quote", r"\S\s+(\S+(?:\s+\S+){%d})" % (n - 1), 1)).otherwise(out), range(1, 5), F.lit(None))
    keyed = quotes.withColumn("h", F.xxhash64(inner, "n"))
    hashed = lambda n: lambda g: F.xxhash64(g, F.lit(n))
    grams = [F.transform(F.array_distinct(F.regexp_extract_all("text", F.lit(word % (n - 1)), 1)), hashed(n)) for n in sorted(used - {0})]
    held = docs.select("doc_id", F.explode(F.concat(*grams)).alias("h"))
    met = held.join(keyed.select("item_id", "h"), "h").select("doc_id", "item_id").distinct()
    long = met.join(quotes.select("item_id", "quote"), "item_id").join(docs.select("doc_id", "text"), "doc_id").where(F.contains("text", "quote")).select("item_id", "doc_id")
    return long.unionByName(short) if 0 in used else long


def word_weights(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, df, weight): document frequency and ln(N / df) of topic words, over all documents."""
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    words = docs.select(F.explode(F.array_distinct(text.topic_words(F.col(text_col)))).alias("word"))
    df = words.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(n)).select("word", "df", F.log(F.col("n") / F.col("df")).alias("weight"))


def topic_matches(docs: DataFrame, words: list[str], ceiling: float = 0.03, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): summed weights of the question's words that a document has, by common stem.

    The frequency of a question's word is over all documents; words in more than the ceiling's share say nothing.
    """
    total = docs.agg(F.count(F.lit(1)).alias("n"))
    asked = docs.sparkSession.createDataFrame([(w,) for w in words], "asked string").withColumn("stem", F.substring("asked", 1, 4))
    own = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.array_distinct(text.topic_words(F.col(text_col)))).alias("word")).withColumn("stem", F.substring("word", 1, 4))
    hits = own.join(F.broadcast(asked), "stem").where(text.same_stem(F.col("word"), F.col("asked"))).select("doc_id", "asked").distinct()  # a question's words are few
    df = hits.groupBy("asked").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(total))
    weights = df.where(F.col("df") <= F.col("n") * ceiling).select("asked", F.log(F.col("n") / F.col("df")).alias("weight"))
    return hits.join(F.broadcast(weights), "asked").groupBy("doc_id").agg(F.sum("weight").alias("score"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(vectors: DataFrame, query: list[float], k: int, signature: Column | None = None) -> DataFrame:
    """The k vectors of largest cosine to the query; with a signature, the best of each signature only."""
    scored = vectors.withColumn("score", cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query])))
    if signature is not None:
        scored = scored.withColumn("_s", signature)
        order = F.struct((-F.col("score")).alias("a"), F.col("vec_id").alias("b"))
        scored = scored.groupBy("_s").agg(F.min_by(F.struct("vec_id", "score"), order).alias("r")).select("r.*")
    order = [F.col("score").desc(), F.col("vec_id")]
    return scored.orderBy(*order).limit(k).select("vec_id", "score", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(*order)).alias("rank"))


#: What the class or id of a layer over the page says that asks for consent to cookies.
LAYER = re.compile("cookie|consent|gdpr", re.I).search


class _Body(HTMLParser):
    EMPTY = {"br", "img", "input", "hr", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
    SKIP, BREAK = {"script", "style", "nav", "header", "footer", "noscript", "form", "title"}, {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "table", "section", "article"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.depth, self.layer, self.layers = 0, "", 0

    def handle_starttag(self, tag, attrs):
        if self.layers:
            self.layers += tag == self.layer
        elif tag not in self.EMPTY and any(k in ("class", "id") and LAYER(v or "") for k, v in attrs):
            self.layer, self.layers = tag, 1
        self.depth += tag in self.SKIP
        if tag in self.BREAK:
            self.out.append("\n")
        elif tag in ("td", "th"):
            self.out.append(" | ")

    def handle_endtag(self, tag):
        self.layers -= self.layers > 0 and tag == self.layer
        self.depth -= tag in self.SKIP and self.depth > 0
        if tag in self.BREAK:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.depth and not self.layers:
            self.out.append(data)


def body_text(html: str | None) -> str:
    """The readable text of a page: scripts, styles, navigation and cookie layers left out, blocks on lines of their own."""
    parser = _Body()
    parser.feed(html or "")
    parser.close()
    return "\n".join(line for line in (" ".join(x.split()).removeprefix("| ") for x in "".join(parser.out).split("\n")) if line)


def bodies(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, body): parsing html needs a parser, so this is Python over Arrow batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"page_id": f["page_id"], "body": f["html"].map(body_text)})

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias("html")).mapInPandas(run, "page_id long, body string")
