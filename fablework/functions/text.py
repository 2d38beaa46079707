"""Column functions for titles, labels, chunk ids and model output; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements whose start or end tag ends an open paragraph.
BLOCKS = ("p|address|article|aside|blockquote|body|dd|details|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hgroup|hr|html|li|main|menu|nav|ol|pre"
          "|search|section|table|tbody|td|tfoot|th|thead|tr|ul")


def html_paragraphs(c: Column) -> Column:
    """Inner HTML of each paragraph; one without a closing tag ends at the next block's start, its container's end or the page's."""
    return F.regexp_extract_all(c, F.lit(rf"(?is)<p(?:\s[^>]*)?>(.*?)(?=</?(?:{BLOCKS})[\s/>]|\z)"), 1)


def normalize_title(c: Column) -> Column:
    """Runs of non-word characters and underscores become one space; trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)[\W_]+", " "))


def clean_title(c: Column) -> Column:
    """Lower-cased, trimmed, runs of non-word characters as one space; null gives ''."""
    return F.regexp_replace(F.trim(F.lower(F.coalesce(c, F.lit("")))), r"(?U)[\W_]+", " ")


def sanitize_node(c: Column) -> Column:
    """ASCII letters and digits joined by single underscores; null where nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(c, "[^A-Za-z0-9]+", "_"), F.lit("_")), F.lit(""))


#: English determiners, pronouns and particles, which name no thing by themselves.
FUNCTION_WORDS = (
    "a an the this that these those some any no every each either neither all both another such what which whose "
    "i me my mine myself you your yours yourself yourselves he him his himself she her hers herself it its itself "
    "we us our ours ourselves they them their theirs themselves one who whom somebody someone something anybody anyone "
    "anything nobody nothing everybody everyone everything to not n't 's '"
).split()


def without_function_words(c: Column) -> Column:
    """The words that are no determiner, pronoun or particle, by single spaces; all of them if none would be left."""
    words = F.filter(F.split(F.trim(c), r"\s+|(?<=\w)(?=(?:'s|n't)\b)"), lambda w: w != "")
    left = F.filter(words, lambda w: ~F.lower(w).isin(FUNCTION_WORDS))
    return F.array_join(F.when(F.size(left) > 0, left).otherwise(words), " ")


def node_name(c: Column) -> Column:
    """``sanitize_node`` of what ``without_function_words`` leaves."""
    return sanitize_node(without_function_words(c))


def title_fields(*columns: Column) -> list[Column]:
    """Trimmed and lower-cased; null is ''."""
    return [F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in columns]


#: The relation of labels that give none, and the name of a node without one.
DEFAULT_RELATION, MISSING_NAME = "RELATED_TO", "<MISSING NAME>"


def sanitize_relation(c: Column, mode: str = "UPPER_CASE", default: str = DEFAULT_RELATION) -> Column:
    """Relation label in UPPER_CASE or camelCase; labels that don't begin with a letter become the default."""
    if mode not in ("UPPER_CASE", "camelCase"):
        raise ValueError(f"unknown mode {mode}")

    def words(x: Column) -> Column:
        x = F.regexp_replace(F.regexp_replace(x, "([a-z])([A-Z])", "$1_$2"), "[^A-Za-z0-9_ ]", "_")
        return F.filter(F.split(x, "[_ ]+"), lambda w: w != "")

    def join(w: Column) -> Column:
        if mode == "UPPER_CASE":
            return F.upper(F.array_join(w, "_"))
        return F.concat(F.lower(F.get(w, F.lit(0))), F.array_join(F.transform(F.slice(w, F.lit(2), F.size(w)), F.initcap), ""))

    made = join(words(c))
    return F.when(made.rlike("^[A-Za-z]"), made).otherwise(join(words(F.lit(default))))


def strip_fence(c: Column) -> Column:
    """Model output without a leading json fence and a trailing fence."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"(?i)^```json\s*", ""), r"\s*```$", ""))


def node_label(name: Column, label: Column, width: int = 20) -> Column:
    """Display label: name, else label, cut to ``width`` with three dots."""
    s = F.coalesce(F.trim(name), F.trim(label), F.lit(MISSING_NAME))
    return F.when(F.length(s) > width, F.concat(F.substring(s, 1, width - 3), F.lit("..."))).otherwise(s)


def rounded(c: Column, digits: int) -> Column:
    """``c`` to ``digits`` places: the product with their power of ten to the nearest whole number, as SQL engines and C round doubles.

    ``F.round`` goes by the shortest decimal text instead: 18.775 may lie just below, and times 100 be 1877.4999999999998.
    """
    power = F.lit(10.0**digits)
    return F.round(c * power) / power


def chunk_id(story: Column, book: Column, chapter: Column, percent: Column) -> Column:
    """``story-S_book-B_chapter-C_p.ddddd``."""
    return F.concat(
        F.lit("story-"), story.cast("string"), F.lit("_book-"), book.cast("string"), F.lit("_chapter-"), chapter.cast("string"),
        F.lit("_p"), F.substring(F.format_string("%.5f", percent / 100), 2, 6))


def char_count(c: Column, prune_newlines: bool = True) -> Column:
    return F.length(F.replace(c, F.lit("\n"), F.lit(""))) if prune_newlines else F.length(c)


def chapter_list(c: Column) -> Column:
    """Trimmed lines that are not blank."""
    return F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def half_of(c: Column) -> Column:
    """The first half by characters, the stand-in for a missing gold summary."""
    return F.substring(c, F.lit(1), F.floor(F.length(c) / 2).cast("int"))


def one_line(c: Column) -> Column:
    """Line breaks as spaces, trimmed: text as extractors and scorers take it."""
    return F.trim(F.replace(c, F.lit("\n"), F.lit(" ")))


def prompt(instruction: str, facts: Column, text: Column) -> Column:
    """Model input of labelled sections; a null section is left out."""
    part = lambda name, c: F.concat(F.lit(f"{name}:\n"), c)
    return F.concat_ws("\n\n", F.lit(instruction), part("Facts", facts), part("Text", text))


def call_chain(frames: Column) -> Column:
    """Outermost first, internal frames left out."""
    return F.array_join(F.filter(F.reverse(frames), lambda f: ~f.startswith("_")), " -> ")


def json_repair(c: Column) -> Column:
    """Lenient JSON as strict JSON text: comments and commas before a closing bracket go, white space becomes one space.

    Strings and backslash pairs stay as they are. A comma also goes if only comments part it from the
    bracket. An unclosed comment or string runs to the end of the text. Null gives null.
    """
    space, kept = r"[ \t\r\n]", r'"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"?|\\[\s\S]'
    c = F.regexp_replace(c, rf"({kept})|/\*[\s\S]*?(?:\*/|\z)|//[^\n]*+\n?", "$1")
    c = F.regexp_replace(c, rf"({kept})|,(?={space}*+[}}\]])", "$1")
    parts = F.regexp_extract_all(c, F.lit(rf'{kept}|{space}++|[^"\\ \t\r\n]++|\\'), F.lit(0))
    return F.trim(F.array_join(F.transform(parts, lambda p: F.when(p.rlike(rf"^{space}+\z"), " ").otherwise(p)), ""))


def metrics_payload(book_id: Column, title: Column, summary: Column, gold: Column, prf: dict[str, tuple[Column, Column, Column]], scalars: dict[str, Column], qa_items: Column | None = None) -> Column:
    """Scores of one book as the nested JSON text that the score viewer reads; null fields stay in it.

    ``prf``: precision, recall and F1 by metric name; ``qa_items``: array of question structs, none if left out.
    """
    # fixed values: the viewer's field names
    triple = [F.struct(F.lit(n).alias("Name"), p.alias("Precision"), r.alias("Recall"), f.alias("F1Score")) for n, (p, r, f) in prf.items()]
    single = [F.struct(F.lit(n).alias("Name"), v.alias("Value")) for n, v in scalars.items()]
    items = F.array() if qa_items is None else qa_items
    metrics = F.struct(F.array(*triple).alias("PRF1Metrics"), F.array(*single).alias("ScalarMetrics"), F.struct(items.alias("QAItems")).alias("QA"))
    whole = F.struct(book_id.cast("string").alias("BookID"), title.alias("BookTitle"), summary.alias("SummaryText"), gold.alias("GoldSummaryText"), metrics.alias("Metrics"), F.array().alias("QAResults"))
    return F.to_json(whole, {"ignoreNullFields": "false"})
