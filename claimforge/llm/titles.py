"""Problem 2: freely typed titles to the entries of a reference list, by a prefix-filter set-similarity join.

Every title gives one or more *forms* (lower case, accents folded, decoration such as "Position:", "(interim)",
"at Firm", ", Firm" taken off step by step, "Officer, Chief Executive" turned round), every reference entry
the forms of its known spellings. A form is the set of its padded letter pairs. Pairs are ordered by how rare they
are over all forms; two sets with Jaccard of at least MIN_JACCARD must share one of the first
|x| - ceil(t|x|) + 1 of them, so only these prefixes are joined, under the length and the positional
filter; the Jaccard is then computed exactly. Titles with a form that equals a known one (Jaccard 1) are settled by equality before. A candidate
counts if its edit distance is one that typing errors explain (``_typing_error``), and each title keeps its best candidate: highest Jaccard, then the longer form,
then the smaller role_id.

All work is on distinct forms; rows are joined again only at the end, on a salted key, so that a title that a third
of all people have is spread over tasks.

Results at the edges: null and blank titles have no row; titles that match nothing, or only mention another person's
role, have role_id -1; repeated rows come out repeatedly; a title of any length is compared whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimforge.llm.common import checkpointed, written
from claimforge.llm.titles_lexicon import spellings

MIN_JACCARD = 0.3
SALTS = 8

_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿœæ"
_FOLDED = "aaaaaaceeeeiiiinoooooouuuuyyoa"


def form(text: Column) -> Column:
    """Letters and digits in lower case, accents folded, nothing between them."""
    low = F.regexp_replace(F.lower(text), "ß", "ss")
    return F.regexp_replace(F.translate(F.regexp_replace(low, r"\p{M}", ""), _ACCENTED, _FOLDED), r"[^\p{L}\p{N}]+", "")


def _turned(text: Column) -> Column:
    """"Officer, Chief Executive" as "Chief Executive Officer"; null without exactly one comma."""
    parts = F.split(text, r"\s*,\s*")
    return F.when(F.size(parts) == 2, F.concat_ws(" ", F.get(parts, 1), F.get(parts, 0)))


def variants(title: Column) -> Column:
    """The forms of a typed title, fullest first."""
    t = F.trim(F.regexp_replace(F.lower(title), r"(?U)\s+", " "))
    bare = F.regexp_replace(t, r"^(?:(?:job )?title|position|current(?:ly)?|role|funktion|fonction|cargo|poste|puesto)\s*(?:[:：]|-\s|–\s)\s*|^[-–—•*·]+\s*", "")
    bare = F.regexp_replace(bare, r"[.;,\s]+$", "")
    no_note = F.trim(F.regexp_replace(bare, r"\s*[\(\[（][^\)\]）]*[\)\]）]\s*$", ""))
    no_firm = F.regexp_replace(no_note, r"\s+(?:at|bei|chez|@)\s+.*$|\s*@.*$", "")
    no_place = F.regexp_replace(no_firm, r"\s+(?:[-–—|/])\s+.*$", "")
    no_tail = F.regexp_replace(no_place, r",[^,]*$", "")
    no_comma = F.regexp_replace(no_place, r",.*$", "")
    texts = [t, bare, no_note, no_firm, no_place, no_tail, no_comma]
    every = F.array(*texts, *[_turned(x) for x in (bare, no_note, no_firm, no_place, no_tail)])
    return F.array_distinct(F.filter(F.transform(F.array_compact(every), form), lambda x: x != ""))


def grams(word: Column) -> Column:
    """The set of letter pairs of a form, padded at both ends."""
    padded = F.concat(F.lit("^"), word, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 1), lambda i: padded.substr(i, F.lit(2))))


def reference_forms(reference: DataFrame) -> DataFrame:
    """(form, role_id): every spelling of the reference's entries; of equal spellings the smaller role_id."""
    spark = reference.sparkSession
    known = spark.createDataFrame(spellings(), "canonical string, spelling string")
    entries = reference.filter(F.col("canonical_title").isNotNull()).select("role_id", "canonical_title")
    own = entries.select("role_id", F.col("canonical_title").alias("spelling"))
    more = entries.join(known, form(F.col("canonical_title")) == form(F.col("canonical"))).select("role_id", "spelling")
    return own.unionByName(more).select("role_id", form(F.col("spelling")).alias("form")).filter("form <> ''").groupBy("form").agg(F.min("role_id").alias("role_id"))


def _prefixes(forms: DataFrame, ranks: DataFrame, t: float, name: str) -> DataFrame:
    """(form, size, position, gram): the first tokens of every form in the order of rarity."""
    ranked = forms.select("form", F.explode("grams").alias("gram")).join(ranks, "gram", "left")
    # Tokens without a rank stand on no reference form: they are rarer than any that could match.
    row = ranked.groupBy("form").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("rank", F.lit(-1)).alias("rank"), "gram"))).alias("order"))
    size = F.size("order")
    kept = row.select("form", size.alias(f"{name}_size"), F.posexplode(F.slice("order", 1, (size - F.ceil(size * t) + 1).cast("int"))).alias(f"{name}_at", "token"))
    return kept.select(F.col("form").alias(f"{name}_form"), f"{name}_size", f"{name}_at", "token.rank", "token.gram")


#: What counts as a typing error is part of the match, beside the Jaccard: one to FARTHEST slips of the keyboard, by the length of the forms.
FARTHEST = 4


def _typing_error(a: Column, b: Column, d: Column) -> Column:
    """Whether forms at distance d (-1: beyond FARTHEST) are equal, or as far apart as one or two slips of the keyboard make them."""
    n = F.least(F.length(a), F.length(b))
    swapped = F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, ""))
    return (d == 0) | ((d > 0) & (((n >= 4) & (d <= 1)) | ((n >= 8) & (d <= 2)) | ((n >= 12) & (d <= 3)) | (n >= 16) | ((n >= 4) & (d == 2) & swapped)))


def match_forms(forms: DataFrame, known: DataFrame, t: float = MIN_JACCARD) -> DataFrame:
    """(form, role_id, jaccard, distance): every verified candidate of every distinct form; known: (form, role_id)."""
    left = checkpointed(forms.select("form").distinct()).withColumn("grams", grams(F.col("form")))
    right = known.withColumn("grams", grams(F.col("form")))
    every = left.select(F.explode("grams").alias("gram")).unionByName(right.select(F.explode("grams").alias("gram")))
    usable = right.select(F.explode("grams").alias("gram")).distinct()
    # Bounded by the reference list: only its tokens can make a match, so only they need a rank.
    counts = every.groupBy("gram").count().join(usable, "gram", "left_semi")
    ranks = counts.select("gram", F.col("count").alias("rank"))
    ranks = checkpointed(ranks)
    x = written(_prefixes(left, ranks, t, "x").filter("rank >= 0").drop("rank"))
    y = written(_prefixes(right, ranks, t, "y").drop("rank"))
    need = F.ceil(F.lit(t / (1 + t)) * (F.col("x_size") + F.col("y_size")))
    near = (
        x.join(y, "gram")
        .filter((F.col("y_size") >= F.ceil(F.col("x_size") * t)) & (F.col("x_size") >= F.ceil(F.col("y_size") * t)))
        .filter(1 + F.least(F.col("x_size") - F.col("x_at") - 1, F.col("y_size") - F.col("y_at") - 1) >= need - F.least("x_at", "y_at"))
        .select("x_form", "y_form")
        .distinct()
    )
    # Written, or the checks would be made before the pairs are made distinct. The cheaper of the two comes first; both must hold.
    near = written(near)
    # Few pairs pass the first test, so the distance is computed once for most.
    close = near.filter(F.levenshtein("x_form", "y_form", FARTHEST) >= 0).withColumn("distance", F.levenshtein("x_form", "y_form", FARTHEST))
    near = close.filter(_typing_error(F.col("x_form"), F.col("y_form"), F.col("distance")))
    gx, gy = grams(F.col("x_form")), grams(F.col("y_form"))
    shared = F.size(F.array_intersect(gx, gy))
    # Written, or a join's runtime filter would check all pairs once more.
    exact = written(near.withColumn("jaccard", shared / (F.size(gx) + F.size(gy) - shared)).filter(F.col("jaccard") >= t))
    return exact.join(known.withColumnRenamed("form", "y_form"), "y_form").select(F.col("x_form").alias("form"), "role_id", "jaccard", "distance")


def match_titles(people: DataFrame, reference: DataFrame, key: str = "person_id", title: str = "title") -> DataFrame:
    """(key, title, role_id, score): one row per row of people whose title isn't null or blank; role_id -1 if unmatched."""
    rows = people.select(F.col(key).alias("_key"), F.col(title).alias("_title")).filter(F.col("_title").isNotNull() & (F.regexp_replace("_title", r"(?U)\s+", "") != ""))
    titles = rows.select("_title").distinct()
    # Computed once: the join reads each of them several times.
    spread = checkpointed(titles.select("_title", F.explode(variants(F.col("_title"))).alias("form")))
    known = checkpointed(reference_forms(reference))
    # Equal sets first: nothing beats a Jaccard of 1 at distance 0, so titles with such a form need no other candidate.
    equal = checkpointed(spread.join(known, "form").select("_title", "form", "role_id", F.lit(1.0).alias("jaccard"), F.lit(0).alias("distance")))
    others = checkpointed(spread.join(equal.select("_title").distinct(), "_title", "left_anti"))
    found = others.join(match_forms(others, known), "form").select("_title", "form", "role_id", "jaccard", "distance")
    best = (
        equal.unionByName(found)
        .groupBy("_title")
        .agg(F.max_by(F.struct("role_id", "jaccard"), F.struct("jaccard", -F.col("distance"), F.length("form"), -F.col("role_id"))).alias("best"))
        .select("_title", "best.role_id", F.col("best.jaccard").alias("score"))
    )
    copies = best.withColumn("_salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("_key"), F.lit(SALTS)).cast("int"))
    joined = salted.join(copies, ["_title", "_salt"], "left")
    return joined.select(F.col("_key").alias(key), F.col("_title").alias(title), F.coalesce("role_id", F.lit(-1)).cast("int").alias("role_id"), F.coalesce("score", F.lit(0.0)).alias("score"))
