"""Text functions over columns: names, template paths, markers, labels. All but one digest stay in Spark's own expressions."""

from __future__ import annotations

from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values of the formats that are read and written ---------------------------------------------------------
QUANTIFIERS = {"": "exactly_one", "!": "exactly_one_auto", "?": "zero_or_one", "+": "one_or_more", "*": "any"}
REPEATING = ("+", "*")
OCCURRENCES = {"": "required", "$": "optional", "+": "one_or_more", "*": "zero_or_more"}
ENTITY_KEYS = ("quote", "segment", "policy", "account", "pricing", "charges", "termCharges")
ROOTS = ("quote", "segment", "policy", "invoice")
AMOUNT_WORDS = ("amount", "premium", "fee", "tax", "price", "cost", "total")
STANDARD_FONTS = ("arial", "helvetica", "times", "times new roman", "courier", "courier new", "serif", "sans-serif", "monospace", "cursive", "fantasy", "system-ui")
FIELD = r"\{([$+*]?)([a-zA-Z_][a-zA-Z0-9_.]*)\}"
VARIANT = r"\[\[\s*\$([A-Za-z_]\w*)\s*\]\]"
MARKER = r"(?<!\[)\[(/?)([A-Za-z_]\w*)([/?]?)\](?!\])"
OPEN_TOKEN = r"\$(?:\w+\.)?TBD_\w+(?:\.\w+)*"
MUSTACHE = r"\{\{\s*([a-zA-Z_][a-zA-Z0-9_]*(?:\.[a-zA-Z_][a-zA-Z0-9_]*)*)\s*\}\}"
SUSPICIOUS = r"\b(XXXX+|X{3,}|TBD|TODO|FIXME)\b"
DOLLARS = r"\$\s?\d[\d,]*(?:\.\d+)?"
FONT_FAMILY = r"(?i)font-family\s*:\s*([^;{}<>]+)"
NEXT_ACTION = r"next-action:\s*([a-z-]+)"


def lookup(values: dict, key: Column) -> Column:
    """The value of a small fixed relation, null if it has none."""
    return F.create_map(*(F.lit(x) for x in chain(*values.items())))[key]


def quantified(token: Column) -> Column:
    """name, quantifier, cardinality and iterable of a token such as Vehicle+ (an empty one has an empty name)."""
    mark = F.regexp_extract(token, r"([!?+*])$", 1)
    name = F.when(mark != "", token.substr(F.lit(1), F.length(token) - 1)).otherwise(token)
    return F.struct(name.alias("name"), mark.alias("quantifier"), lookup(QUANTIFIERS, mark).alias("cardinality"), mark.isin(*REPEATING).alias("iterable"))


def lower_first(name: Column) -> Column:
    return F.concat(F.lower(F.left(name, F.lit(1))), name.substr(F.lit(2), F.length(name)))


def list_key(name: Column) -> Column:
    """Vehicle -> vehicles; a name that ends in s keeps it."""
    low = lower_first(name)
    return F.when(low.endswith("s"), low).otherwise(F.concat(low, F.lit("s")))


def _after(path: Column, prefix: str) -> Column:
    return F.when(path.startswith(prefix), path.substr(F.lit(len(prefix) + 1), F.length(path)))


def accessor(path: Column, category: Column) -> Column:
    """What an author writes for a template path: $data.x of system and policy fields is policy.x, of quotes quote.x."""
    path, category = F.trim(F.coalesce(path, F.lit(""))), F.trim(F.coalesce(category, F.lit("")))
    tail, bare = _after(path, "$data."), F.regexp_replace(path, r"^\$+", "")
    owner = F.when(category.isin("system", "policy_data"), F.lit("policy.")).when(category == "quote_system", F.lit("quote."))
    return F.when(owner.isNotNull(), F.coalesce(F.concat(owner, tail), bare)).otherwise(F.coalesce(tail, F.regexp_replace(path, r"^\$", "")))


def condition_accessor(path: Column, category: Column) -> Column:
    """As accessor, for paths that a condition on a document may name; empty for all others."""
    path = F.trim(F.coalesce(path, F.lit("")))
    owner = F.when(category == "quote_system", F.lit("quote.")).when(category.isin("system", "policy_data"), F.lit("policy."))
    return F.coalesce(F.concat(owner, F.coalesce(_after(path, "$data."), path)), F.lit(""))


def catalog_path(path: Column, category: Column) -> Column:
    """Quote fields lie under $data.quote."""
    return F.when(category == "quote_system", F.coalesce(F.concat(F.lit("$data.quote."), _after(path, "$data.")), path)).otherwise(path)


def root_splice(path: Column, root: Column) -> Column:
    """A root-relative path with the key of the entity it is rendered from; paths that name one stay."""
    rest = _after(path, "$data.")
    named = F.split_part(rest, F.lit("."), F.lit(1)).isin(*ENTITY_KEYS)
    key = F.when(root == "quote", F.lit("quote")).when(root == "segment", F.when(rest.startswith("data."), F.lit("segment")).otherwise(F.lit("policy")))
    return F.when(rest.isNull() | named | key.isNull(), path).otherwise(F.concat(F.lit("$data."), key, F.lit("."), rest))


def loose(text: Column) -> Column:
    """Letters and figures alone, in lower case."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]", "")


def singular(name: Column) -> Column:
    low, cut = F.lower(name), lambda n: F.left(name, F.length(name) - n)
    return (
        F.when(low.endswith("ies") & (F.length(name) > 3), F.concat(cut(3), F.lit("y")))
        .when(low.rlike("(ses|xes|zes|ches|shes)$"), cut(2))
        .when(low.endswith("s") & ~low.endswith("ss") & (F.length(name) > 1), cut(1))
        .otherwise(F.concat(name, F.lit("_item")))
    )


def plural(word: Column) -> Column:
    low = F.lower(word)
    return (
        F.when(low.endswith("s"), word)  # taken for a plural
        .when(low.rlike("[^aeiou]y$"), F.concat(F.left(word, F.length(word) - 1), F.lit("ies")))
        .when(low.rlike("(x|z|ch|sh)$"), F.concat(word, F.lit("es")))
        .otherwise(F.concat(word, F.lit("s")))
    )


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def camel(name: Column) -> Column:
    parts = F.split(name, "_")
    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda p: F.concat(F.upper(F.left(p, F.lit(1))), p.substr(F.lit(2), F.length(p))))
    return F.concat(F.get(parts, F.lit(0)), F.array_join(rest, ""))


def field_name(name: Column) -> Column:
    """SCREAMING_SNAKE in lower case, all else as it is."""
    return F.when(name.rlike("^[A-Z][A-Z0-9_]*$"), F.lower(name)).otherwise(name)


def html_escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def open_markers(text: Column) -> Column:
    """{name} -> $TBD_name."""
    return F.regexp_replace(text, FIELD, r"\$TBD_$2")


def shown_markers(text: Column) -> Column:
    """$TBD_name -> {name}, for display."""
    return F.regexp_replace(text, r"\$(?:\w+\.)?TBD_(\w+(?:\.\w+)*)", "{$1}")


def quiet(value: Column, optional: bool, name: str = "value") -> Column:
    """Text of a value: an optional null is empty, a required one stops the job."""
    text = value.cast("string")
    return F.coalesce(text, F.lit("")) if optional else F.coalesce(text, F.raise_error(F.lit(f"{name} is required")).cast("string"))


def charge_path(label: Column, amount: Column, whole: Column) -> Column:
    """The amount's path if the label speaks of one, else the object's; the other if the first is not there."""
    money = F.lower(F.coalesce(label, F.lit(""))).rlike("|".join(AMOUNT_WORDS))
    present = lambda c: F.nullif(c, F.lit(""))
    return F.when(money, F.coalesce(present(amount), present(whole), F.lit(""))).otherwise(F.coalesce(present(whole), present(amount), F.lit("")))


def quantifier_note(quantifier: Column, path: Column) -> Column:
    return F.when(quantifier == "?", F.concat(F.lit("may be absent: guard "), path)).when(quantifier == "!", F.lit("always present")).otherwise(F.lit(""))


def next_action(reason: Column) -> Column:
    return F.regexp_extract(F.coalesce(reason, F.lit("")), NEXT_ACTION, 1)


def without_next_action(reason: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(reason, F.lit("")), r"\s*—\s*next-action:\s*[a-z-]+", ""))


def shown_label(nearest: Column, heading: Column) -> Column:
    return F.coalesce(F.nullif(nearest, F.lit("")), F.nullif(heading, F.lit("")), F.lit(""))


def clean_label(text: Column) -> Column:
    """A label of at most 80 characters without its colon; empty if it is a marker itself."""
    label = F.trim(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), ":+$", ""))
    return F.when(label.rlike(r"\$|TBD_|\{\{"), F.lit("")).otherwise(F.left(label, F.lit(80)))


def declared_roots(file_name: Column) -> Column:
    """roots (distinct, as listed; the first is primary) and error of a name such as Letter(quote,segment).html."""
    stem = F.regexp_extract(F.trim(F.coalesce(file_name, F.lit(""))), r"([^/]*)$", 1)
    groups = F.regexp_extract_all(stem, F.lit(r"\(([^()]*)\)"), 1)
    listed = F.filter(F.transform(F.split(F.element_at(F.when(F.size(groups) > 0, groups), -1), ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    known = F.array(*(F.lit(r) for r in ("quote", "segment", "invoice")))
    strange = F.array_except(listed, known)
    error = (
        F.when(F.size(groups) == 0, F.lit("no root declared"))
        .when(F.size(listed) == 0, F.lit("no root listed"))
        .when(F.size(strange) > 0, F.concat(F.lit("unknown root: "), F.array_join(strange, ", ")))
    )
    return F.struct(F.when(error.isNull(), F.array_distinct(listed)).otherwise(F.array().cast("array<string>")).alias("roots"), error.alias("error"))


def document_scope(primary: Column) -> Column:
    """Which records a document's conditions see; null without a root."""
    return F.when(primary == "quote", F.lit("quote")).when(primary.isNotNull(), F.lit("policy"))


def fonts(df: DataFrame, key: str, text: str) -> DataFrame:
    """Fonts that are first in a font-family stack and not standard, in the spelling met first: key, font."""
    first = F.trim(F.regexp_replace(F.trim(F.split_part("stack", F.lit(","), F.lit(1))), "^['\"]+|['\"]+$", ""))
    found = df.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(FONT_FAMILY), 1)).alias("pos", "stack")).select(key, "pos", first.alias("font"))
    found = found.where((F.col("font") != "") & ~F.lower("font").isin(*STANDARD_FONTS))
    return found.groupBy(key, F.lower("font").alias("low")).agg(F.min_by("font", "pos").alias("font")).select(key, "font")


#: Bytes of texts that a flat fingerprint reads in one task at most.
FLAT = 256 * 2**20


def fingerprint(df: DataFrame, path: str, text: str) -> DataFrame:
    """One row: SHA-256 over path, line end, text, line end of all files, by path.

    A digest over all texts one after another is made in one task, so their bytes are summed first: more than FLAT are an
    error, for which there are streamed_fingerprint and tree_fingerprint.
    """
    total = df.agg(F.sum(F.octet_length(path).cast("long") + F.octet_length(text))).first()[0] or 0
    if total > FLAT:
        raise ValueError(f"{total} bytes are too many for one digest over all of them; tree_fingerprint takes any number")
    files = F.array_sort(F.collect_list(F.struct(F.col(path).alias("p"), F.col(text).alias("t"))))
    joined = F.array_join(F.transform(files, lambda f: F.concat(f["p"], F.lit("\n"), f["t"], F.lit("\n"))), "")
    return df.agg(F.sha2(joined.cast("binary"), 256).alias("fingerprint"))


def streamed_fingerprint(df: DataFrame, path: str, text: str) -> DataFrame:
    """The row of fingerprint, for any number of bytes. Each block of SHA-256 needs the digest of all before it, so one task
    has to read the texts one after another; it holds a batch of them at a time, and the sort before it spills."""
    import hashlib

    def run(batches):
        digest = hashlib.sha256()
        for batch in batches:
            for file in batch.column(0):
                if file.is_valid:
                    digest.update(file.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([digest.hexdigest()])], names=["fingerprint"])

    files = df.select(F.col(path).alias("p"), F.col(text).alias("t")).repartition(1).sortWithinPartitions("p", "t")
    found = files.select(F.concat("p", F.lit("\n"), "t", F.lit("\n")).cast("binary").alias("file")).mapInArrow(run, "fingerprint string")
    return found.agg(F.coalesce(F.max("fingerprint"), F.lit(hashlib.sha256().hexdigest())).alias("fingerprint"))


def tree_fingerprint(df: DataFrame, path: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(sections, whole): section, files, digest of each section (a path up to its first slash), and one row of files and
    fingerprint, the digest over all sections. A text is digested where it is; what is gathered of a section is a digest for each of its
    files, by path, and of the whole a digest for each section. Sections that differ tell where two trees do."""
    files = df.select(F.split_part(path, F.lit("/"), F.lit(1)).alias("section"), F.col(path).alias("p"), F.sha2(F.concat(F.col(path), F.lit("\n"), F.col(text)).cast("binary"), 256).alias("d"))
    over = lambda rows, item: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(rows)), item), "\n").cast("binary"), 256)
    sections = files.groupBy("section").agg(F.count("*").alias("files"), over(F.struct("p", "d"), lambda x: F.concat(x["p"], F.lit(" "), x["d"])).alias("digest"))
    return sections, sections.agg(F.sum("files").alias("files"), over(F.struct("section", "digest"), lambda x: F.concat(x["section"], F.lit(" "), x["digest"])).alias("fingerprint"))
