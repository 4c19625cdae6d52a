"""Problem 6: variant spellings of one person or organisation, by radius joins in a partitioned metric space.

The metric is the Levenshtein distance between keys: of a person "surname given" (order, case, accents, forms of
address, middle initials and nicknames resolved), of a company its brand, that is, its name without legal
forms and without words that stand with many brands. Keys are compared within a block: people of one company, companies of one sector.

``radius_join`` finds all pairs of keys within radius r of a block, exactly. Nearest-pivot cells alone don't divide such short
strings: distances to pivots differ by less than the 2r of the boundary, so nearly every name would be copied to nearly every
cell (README has figures). A cell is therefore (block, segment, ring): keys within distance r share one of r + 1
segments of the shorter key near its place, and lie in the same or a neighbouring ring around a pivot. A key is at home in one ring
and copied to the rings that the triangle inequality allows; further pivots prune pairs within a cell by the same inequality;
the edit distance of what is left is computed. Only distinct keys take part; copies join their class at the end.

Links are then checked field by field (given names, initials, second words of firms), as kin share a surname and sister
firms a brand.

Results at the edges: null, empty and unreadable names link to nothing; equal rows (other ids) link to each other; a name of any
length is compared whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimforge.llm.common import written

PIVOTS = 4
#: Keys of a block that are compared with one another without cells: a key would have about as many copies.
WHOLE = 100
#: Rows of a class that one task takes on each side when pairs of rows are asked for.
PIECE = 2_000
#: A word that stands with at least this many different brands says nothing of the brand. How many companies have it doesn't count: they may be one.
COMMON_LEAST = 12

# Forms of address, legal forms, second words of firms with their short forms, given names with short forms.
ADDRESS = set("mr mrs ms miss mx dr prof professor sir dame herr frau hr fr mme mlle m. monsieur madame sr sra srta señor señora don doña dipl ing med phd mba jr sen".split())
LEGAL = set(
    "inc incorporated corp corporation co company llc ltd limited plc llp lp gmbh mbh ag kg kgaa ug ohg se sa sas sarl sasu eurl sl slu srl spa ab oy as aps bv nv kk ood ad eood sro oü ou zrt kft "
    "aktiengesellschaft kabushiki kaisha sociedad limitada anonima societe anonyme public the and und et y de gesellschaft beschrankter haftung mit partnership liability responsabilite limitee simplifiee actions par".split()
)
SECOND = {
    "technologies": "technology tech techs technol techn", "systems": "system sys syst", "manufacturing": "mfg manuf manufg manufact", "software": "sw softw soft",
    "associates": "assoc assocs associate associated", "solutions": "sol soln solns solution", "international": "intl int'l int internat", "logistics": "logist log logis",
    "management": "mgt mgmt mgmnt manag", "services": "svcs svc serv service srvcs", "group": "grp", "holding": "holdings hldg", "industries": "ind inds industry", "partners": "partner ptnrs",
    "consulting": "consult consultants", "enterprises": "enterprise ent", "trading": "trdg", "engineering": "eng engrg", "development": "dev devt",
}
NICKNAMES = {
    "susanne": "susi sanne suse", "edward": "ned ted ed eddie teddy eddy", "samuel": "sam sammy", "katherine": "kathy kate kit katie kat", "angela": "angie geli", "ulrike": "ulli rike uli",
    "francisco": "paco pancho curro fran", "nicholas": "nick nico nicky", "helena": "lena nell nelly", "friedrich": "fritz fred freddy", "jose": "pepe", "johannes": "hannes hans jo",
    "beatriz": "bea bia", "jurgen": "jorg", "margaret": "maggie peggy meg greta madge peg", "monica": "moni", "thomas": "tom tommy", "rebecca": "becky becca", "elizabeth": "liz beth betty lisa eliza lizzie bess",
    "michael": "mike mick mickey", "alexander": "alex sasha sandy alec xander", "tobias": "toby tobi", "benjamin": "ben benny", "anthony": "tony ant", "william": "bill will billy liam willy",
    "katharina": "kathi katja kathe kati", "giuseppe": "beppe peppe peppino pino", "patricia": "pat trish patty tricia", "lukas": "luke luk", "theodore": "ted teddy theo", "dolores": "lola loli",
    "zoltan": "zoli", "jennifer": "jenny jen", "victoria": "vicky vic tori", "deborah": "debbie deb", "joachim": "jochen achim", "christopher": "chris kit topher", "gregory": "greg",
    "ignacio": "nacho", "robert": "bob rob bobby robbie", "marlene": "leni", "quentin": "quin", "clara": "clary", "ingrid": "inga", "nadia": "nadya", "oscar": "ossi", "wanda": "wandi", "yvonne": "vonnie",
    "andre": "dre", "james": "jim jimmy jamie", "john": "jack johnny", "richard": "dick rick rich", "charles": "charlie chuck", "henry": "harry hank", "catherine": "cathy cate", "daniel": "dan danny",
    "david": "dave", "joseph": "joe", "matthew": "matt", "stephen": "steve", "peter": "pete", "andrew": "andy drew", "philip": "phil",
}


@lru_cache(1)
def _formal() -> dict[str, tuple[str, ...]]:
    """The given names that a short form may stand for."""
    out: dict[str, list[str]] = {}
    for name, short in NICKNAMES.items():
        for s in short.split():
            out.setdefault(s, []).append(name)
    return {s: tuple(x) for s, x in out.items()}


def _fold(text: str) -> str:
    import unicodedata

    text = text.lower().replace("ß", "ss").replace("ø", "o").replace("æ", "ae").replace("œ", "oe").replace("đ", "d").replace("ł", "l").replace("þ", "th").replace("ı", "i")
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


def person_parts(name: str | None) -> tuple[str, str] | None:
    """(surname, given) in folded letters; given is a single letter if only the initial stands; None if unreadable."""
    if not name:
        return None
    text = re.sub(r"[\"“”()\[\]]", " ", name).strip().strip(",")
    turned = None
    if "," in text:
        last, _, first = text.partition(",")
        if last.strip() and first.strip():
            turned = last.split(), first.split()
    words = lambda seq: [w for w in seq if _fold(w).rstrip(".") not in ADDRESS or (len(w) == 1 and w.isupper())]
    if turned:
        last, first = words(turned[0]), words(turned[1])
    else:
        seq = words(text.split())
        if len(seq) < 2:
            return None
        letters = [re.sub(r"[^\w]", "", w) for w in seq]
        loud = [len(x) > 1 and x.isupper() for x in letters]
        if len(letters[-1]) == 1 and len(letters[0]) > 1:  # "Marsk A."
            last, first = seq[:1], seq[-1:]
        elif loud[0] and not loud[-1] and len(letters[-1]) > 1:  # "MARSK Anna"
            n = next(i for i, x in enumerate(loud) if not x)
            last, first = seq[:n], seq[n:]
        elif loud[0] and len(seq) > 2 and not loud[-1]:
            last, first = seq[:1], seq[1:]
        else:
            last, first = seq[-1:], seq[:-1]
    surname = "".join(re.sub(r"[^\w]", "", _fold(w)) for w in last)
    plain = [re.sub(r"[^\w]", "", _fold(w)) for w in first]
    plain = [w for w in plain if w]
    if not surname or not plain:
        return None
    given = next((w for w in plain if len(w) > 1), plain[0])
    return surname, given


def givens(given: str) -> tuple[str, ...]:
    """The formal names that a given name may stand for: itself, unless it is a known short form."""
    return _formal().get(given, (given,))


def _segments(n: int, r: int) -> list[tuple[int, int]]:
    """(start, length) of the r + 1 parts of a key of length n."""
    parts, start = [], 0
    for i in range(r + 1):
        length = n // (r + 1) + (1 if i >= r + 1 - n % (r + 1) else 0)
        parts.append((start, length))
        start += length
    return parts


def _home(s: str, r: int) -> list[str]:
    return [f"{len(s)}.{i}.{s[a : a + n]}" for i, (a, n) in enumerate(_segments(len(s), r))]


def _visits(s: str, r: int) -> set[str]:
    """Every home segment that a key of at most this length within distance r can share with s."""
    out = set()
    for length in range(max(1, len(s) - r), len(s) + 1):
        gap = len(s) - length
        for i, (a, n) in enumerate(_segments(length, r)):
            for start in range(max(0, a - i, a + gap - (r - i)), min(len(s) - n, a + i, a + gap + (r - i)) + 1):
                out.add(f"{length}.{i}.{s[start : start + n]}")
    return out


def radius_join(keys: DataFrame, r: int) -> DataFrame:
    """(block, a, b, d): all pairs of different keys of a block within Levenshtein distance r, each pair once.

    keys: (block string, s string), taken as distinct. A block of at most WHOLE keys is one cell; the pivots are the PIVOTS keys of smallest
    hash in larger ones. Jobs run when called.
    """
    distinct = written(keys.filter("block IS NOT NULL AND s <> ''").select("block", "s").distinct())
    # A key alone in its block has no partner.
    several = distinct.join(distinct.groupBy("block").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "block")
    side = lambda df, x: df.select("block", F.col("s").alias(x))
    once = (F.length("a") < F.length("b")) | ((F.length("a") == F.length("b")) & (F.col("a") < F.col("b")))
    within = lambda df: df.withColumn("d", F.levenshtein("a", "b", r)).filter(F.col("d") >= 0).select("block", "a", "b", "d")
    small = several.filter(F.col("n") <= WHOLE)
    near = within(side(small, "a").join(side(small, "b"), "block").filter(once & (F.length("b") - F.length("a") <= r)))
    large = several.filter(F.col("n") > WHOLE)
    pivots = [row.s for row in large.select("s").distinct().orderBy(F.xxhash64("s"), "s").limit(PIVOTS).collect()]
    if pivots:
        near = near.unionByName(within(_in_cells(large.select("block", "s"), pivots, r).filter(once)).distinct())
    return written(near)


def _in_cells(keys: DataFrame, pivots: list[str], r: int) -> DataFrame:
    """(block, a, b): the pairs of a cell that the pivots don't rule out; a pair of several cells several times.

    The distances to the pivots go along as a byte each; what is cut at 255 differs by no more than before.
    """
    far = [F.least(F.levenshtein("s", F.lit(p)), F.lit(255)).cast("bigint") for p in pivots]
    packed = reduce(lambda x, y: x.bitwiseOR(y), [F.shiftleft(d, 8 * k) for k, d in enumerate(far)])
    # By number, or adaptive execution would give the few bytes of the keys to one task.
    spread = keys.withColumn("far", packed).repartition(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block", "s")

    def cells(home: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                take, cell = [], []
                for k, (s, f) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                    d = f & 255
                    # The few home segments go to all rings within reach, so that the many visits stay in one.
                    if home:
                        rings = range(max(0, d - r) // (r + 1), (d + r) // (r + 1) + 1)
                        mine = [f"{x}.{ring}" for x in _home(s, r) for ring in rings]
                    else:
                        mine = [f"{x}.{d // (r + 1)}" for x in _visits(s, r)]
                    take += [k] * len(mine)
                    cell += mine
                rows = batch.take(pa.array(take, pa.int64()))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(cell, pa.string())], names=["block", "s", "far", "cell"])

        return spread.mapInArrow(run, "block string, s string, far bigint, cell string").withColumn("cell", F.xxhash64("block", "cell"))

    left = cells(True).select("block", "cell", F.col("s").alias("a"), F.col("far").alias("fa"))
    right = cells(False).select("block", "cell", F.col("s").alias("b"), F.col("far").alias("fb"))
    byte = lambda c, k: F.shiftright(c, 8 * k).bitwiseAND(F.lit(255))
    pruned = reduce(lambda x, y: x & y, [F.abs(byte("fa", k) - byte("fb", k)) <= r for k in range(len(pivots))])
    return left.join(right, ["block", "cell"]).filter(pruned).select("block", "a", "b")


def pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id_a, id_b): all pairs of rows of one class or of linked classes, id_a < id_b.

    members: (id, class_id); links: (class_a, class_b). Rows that are in the same classes are one kind. Pairs are told apart between kinds, of which each
    row has one, so that the pairs of rows, by far the most, are neither shuffled nor compared again. Jobs run when called.
    """
    kinds = written(members.filter("id IS NOT NULL").groupBy("id").agg(F.array_sort(F.collect_set("class_id")).alias("of")).select("id", F.xxhash64("of").alias("kind"), "of"))
    in_class = written(kinds.select(F.col("kind").alias("id"), F.explode("of").alias("class_id")).distinct())
    ordered = lambda df, a, b, x, y: df.filter(f"{a} <> {b}").select(F.least(a, b).alias(x), F.greatest(a, b).alias(y)).distinct()
    near = written(ordered(_expanded(in_class, ordered(links, "class_a", "class_b", "class_a", "class_b")), "ia", "ib", "class_a", "class_b"))
    rows = _expanded(kinds.select("id", F.col("kind").alias("class_id")), near)
    return rows.select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"))


def _expanded(members: DataFrame, links: DataFrame) -> DataFrame:
    """(ia, ib): the pairs of members of one class, each once, and of linked classes (class_a < class_b, each link once).

    Only classes of more than PIECE members are cut into pieces, every piece of one meeting every piece of the other, so that no
    task has all the pairs of a class that a third of all rows are in.
    """
    # Classes of one row have no pairs of their own, and few have more rows than a piece: what is joined for the cut is small.
    sized = written(members.groupBy("class_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    large = sized.filter(F.col("n") > PIECE).select("class_id", F.ceil(F.col("n") / PIECE).cast("int").alias("n"))
    cuts = lambda c: F.coalesce(F.col(c), F.lit(1))
    placed = members.join(large, "class_id", "left").select("id", "class_id", F.pmod(F.xxhash64("id"), cuts("n")).cast("int").alias("at"))
    side = lambda x: large.select(F.col("class_id").alias(f"class_{x}"), F.col("n").alias(f"n_{x}"))
    every = links.select("class_a", "class_b").unionByName(sized.select(F.col("class_id").alias("class_a"), F.col("class_id").alias("class_b")))
    upto = lambda x: F.explode(F.sequence(F.lit(0), cuts(f"n_{x}") - 1)).alias(f"at_{x}")
    cut = every.join(side("a"), "class_a", "left").join(side("b"), "class_b", "left").select("class_a", "class_b", "n_b", upto("a")).select("class_a", "class_b", "at_a", upto("b"))
    of = lambda x: placed.select(F.col("class_id").alias(f"class_{x}"), F.col("at").alias(f"at_{x}"), F.col("id").alias(f"i{x}"))
    apart = cut.filter("class_a <> class_b OR at_a <= at_b")
    return apart.join(of("a"), ["class_a", "at_a"]).join(of("b"), ["class_b", "at_b"]).filter("class_a <> class_b OR at_a < at_b OR ia < ib").select("ia", "ib")


def _swapped(a, b):
    return F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, ""))


def person_pairs(people: DataFrame) -> DataFrame:
    """(id_a, id_b): rows of people of one company that spell one person."""
    return pairs(*person_classes(people))


def person_classes(people: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, class_id) and (class_a, class_b): rows of equal keys (company, surname, given name) are one class; the links are between classes.

    A short form of several given names puts its row into the class of each.
    """
    named = _named(people)
    return _person_members(named), _person_links(named)


def person_members(people: DataFrame) -> DataFrame:
    """The first part of ``person_classes``, without the search for links."""
    return _person_members(_named(people))


def _person_class(*c: str) -> Column:
    return F.xxhash64("company", *c)


def _person_members(named: DataFrame) -> DataFrame:
    return named.select("id", _person_class("last", "first").alias("class_id")).distinct()


def _named(people: DataFrame) -> DataFrame:
    """(id, company, last, first), in as many rows as there are formal given names; written."""
    from claimforge.llm import lookalike

    source = people.filter(F.col("company_id").isNotNull() & F.col("name").isNotNull()).select("person_id", F.col("company_id").cast("string").alias("company"), "name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, firms, last, first = [], [], [], []
            for i, c, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), lookalike.clean_array(batch.column(2).cast(pa.string())).to_pylist()):
                parts = person_parts(name)
                if parts:
                    for given in givens(parts[1]):
                        ids.append(i), firms.append(c), last.append(parts[0]), first.append(given)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(firms, pa.string()), pa.array(last, pa.string()), pa.array(first, pa.string())], names=["id", "company", "last", "first"])

    return written(source.mapInArrow(run, "id bigint, company string, last string, first string"))


def _person_links(named: DataFrame) -> DataFrame:
    # Full names: one metric ball over "surname given", then each part on its own.
    full = named.filter(F.length("first") > 1).withColumn("s", F.concat_ws(" ", "last", "first"))
    close = radius_join(full.select(F.col("company").alias("block"), "s"), 2)
    part = lambda c, k: F.substring_index(F.col(c), " ", k)
    d_last, d_first = F.levenshtein(part("a", 1), part("b", 1)), F.levenshtein(part("a", -1), part("b", -1))
    n_first = F.least(F.length(part("a", -1)), F.length(part("b", -1)))
    same = (
        ((d_last <= 1) | (F.least(F.length(part("a", 1)), F.length(part("b", 1))) >= 6))
        & ((d_first == 0) | ((d_first == 1) & (n_first >= 4)) | ((d_first == 2) & (n_first >= 4) & _swapped(part("a", -1), part("b", -1))) | ((d_first == 2) & (n_first >= 7)))
    )
    links = close.filter(same).select(F.col("block").alias("company"), part("a", 1).alias("last_a"), part("a", -1).alias("first_a"), part("b", 1).alias("last_b"), part("b", -1).alias("first_b"))
    # Initials: the ball is over surnames of one company and initial. Only rows that share both with a lone initial are looked at.
    initial = named.select("company", "last", "first", F.substring("first", 1, 1).alias("i"))
    short = initial.filter(F.length("first") == 1).select("company", "i").distinct()
    lettered = written(initial.join(short, ["company", "i"], "left_semi").select(F.concat_ws("|", "company", "i").alias("block"), "company", "last", "first").distinct())
    around = radius_join(lettered.select("block", F.col("last").alias("s")), 1)
    both = around.select("block", "a", "b").unionByName(around.select("block", F.col("b").alias("a"), F.col("a").alias("b"))).filter(F.least(F.length("a"), F.length("b")) >= 4)
    from_short = lettered.filter(F.length("first") == 1).select("block", "company", F.col("last").alias("a"), F.col("first").alias("first_a"))
    own = from_short.select("block", "a", F.col("a").alias("b"))
    reach = own.unionByName(both).distinct()
    to_any = lettered.select("block", F.col("last").alias("b"), F.col("first").alias("first_b"))
    by_initial = from_short.join(reach, ["block", "a"]).join(to_any, ["block", "b"]).select("company", F.col("a").alias("last_a"), "first_a", F.col("b").alias("last_b"), "first_b")
    every = links.unionByName(by_initial).select(_person_class("last_a", "first_a").alias("class_a"), _person_class("last_b", "first_b").alias("class_b"))
    return every.filter("class_a <> class_b").distinct()


def firm_words(name: str) -> list[str]:
    """The folded words of a firm's name, dotted short forms joined ("S. L." and "S.L." are sl)."""
    text = _fold(name)
    text = re.sub(r"\b(\w)\.\s?(?=\w\b)", r"\1", text)
    text = re.sub(r"\b((?:\w\s?\.\s?){2,})", lambda m: re.sub(r"[\s.]", "", m[1]) + " ", text)
    text = re.sub(r"(?<=\w)[-‐](?=\w)", "", text.replace("int'l", "intl").replace("'", ""))
    return re.findall(r"\w+", text)


def firm_keys(name: str | None, common: frozenset[str], short: dict[str, str], near_to) -> list[tuple[str, str, str]]:
    """(brand, sector words, second words) of a firm's name, with the brand's words as they stand and sorted; none if it has no brand or is only an acronym."""
    if not name or re.fullmatch(r"\s*[A-Z]{2,5}\s*", name):
        return []
    brand, sector, second = [], set(), set()
    for w in firm_words(name):
        if w in LEGAL:
            continue
        if w in short:
            second.add(short[w])
        elif w in common:
            sector.add(w)
        elif len(w) >= 4 and (near := near_to(w)):
            (second if near in short else sector).add(short.get(near, near))
        else:
            brand.append(w)
    return [(word, " ".join(sorted(sector)), " ".join(sorted(second))) for word in {"".join(brand), "".join(sorted(brand))} if len(word) >= 3]


def _whole_key(name: str | None) -> list[tuple[str, str, str]]:
    """The key of a name that has nothing but common words: all of them."""
    if not name or re.fullmatch(r"\s*[A-Z]{2,5}\s*", name):
        return []
    words = firm_words(name)
    word = "".join(w for w in words if w not in LEGAL) or "".join(words)
    return [(word, "", "")] if len(word) >= 3 else []


def _common_words(spelled: DataFrame, short: dict[str, str]) -> frozenset[str]:
    """The words that stand with at least COMMON_LEAST different remaining brands, a brand being what itself stands with fewer.

    Jobs run when called; the words of firms' names that stand with so many others go to the driver, which a vocabulary bounds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near_to = _near(sorted(short))
        for batch in batches:
            pairs = set()
            for name in batch.column(0).to_pylist():
                core = [w for w in firm_words(name or "") if w not in LEGAL and w not in short and not (len(w) >= 4 and near_to(w))]
                for i, w in enumerate(core):
                    if len(w) >= 4 and (rest := "".join(core[:i] + core[i + 1 :])):
                        pairs.add((w, rest))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.string()) for k in (0, 1)], names=["w", "rest"])

    pairs = written(spelled.select("name").distinct().mapInArrow(run, "w string, rest string").distinct())
    many = [r.w for r in pairs.groupBy("w").count().filter(F.col("count") >= COMMON_LEAST).select("w").collect()]

    def brands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # What stands with many others, also if mistyped, is no brand.
        known, near_to = frozenset(many), _near(sorted(many))
        for batch in batches:
            rest = batch.column(1).to_pylist()
            yield batch.filter(pa.array([x not in known and not near_to(x) for x in rest], pa.bool_()))

    left = pairs.mapInArrow(brands, "w string, rest string")
    return frozenset(r.w for r in left.groupBy("w").count().filter(F.col("count") >= COMMON_LEAST).select("w").collect())


def _one_slip(a: str, b: str) -> bool:
    """Whether words differ in a letter more, less or other, or in two swapped ones."""
    n, m = len(a), len(b)
    i = 0
    while i < min(n, m) and a[i] == b[i]:
        i += 1
    if n == m:
        return a[i + 1 :] == b[i + 1 :] or (i + 1 < n and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :])
    return (n == m + 1 and a[i + 1 :] == b[i:]) or (m == n + 1 and a[i:] == b[i + 1 :])


def _near(known: list[str]):
    """The finder of the first known word of five letters or more that is one slip away (or equal).

    Words one slip apart share a form with at most one letter left out; a swap of neighbours does too.
    """
    places: dict[str, list[int]] = {}
    for k, word in enumerate(known):
        if len(word) >= 5:
            for x in {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}:
                places.setdefault(x, []).append(k)

    @lru_cache(200_000)
    def find(word: str) -> str | None:
        met = {k for x in {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))} for k in places.get(x, ())}
        return next((known[k] for k in sorted(met) if _one_slip(word, known[k])), None)

    return find


def company_pairs(companies: DataFrame) -> DataFrame:
    """(id_a, id_b): rows of companies that spell one organisation."""
    return pairs(*company_classes(companies))


def company_classes(companies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, class_id) and (class_a, class_b): names of one brand, common words and second words are one class; the links are between classes.

    A row is in the class of each of its names. Brand words are taken as they stand and in alphabetical order.
    """
    keyed = _keyed(companies)
    return _company_members(keyed), _company_links(keyed)


def company_members(companies: DataFrame) -> DataFrame:
    """The first part of ``company_classes``, without the search for links."""
    return _company_members(_keyed(companies))


def _company_members(keyed: DataFrame) -> DataFrame:
    return keyed.select("id", F.xxhash64("sector", "brand", "second").alias("class_id")).distinct()


def _keyed(companies: DataFrame) -> DataFrame:
    """(id, brand, sector, second) of every name of a company; written."""
    names = F.array_distinct(F.array_compact(F.concat(F.array("legal_name", "canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))))
    spelled = companies.select("company_id", F.explode(names).alias("name"))
    short = {s: k for k, v in SECOND.items() for s in [k, *v.split()]}
    common = _common_words(spelled, short)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near_to, near_short = _near(sorted(common | short.keys())), _near(sorted(short))
        # No name may lose its last word: first the common words count again, then all.
        keys = lambda n: firm_keys(n, common, short, near_to) or firm_keys(n, frozenset(), short, near_short) or _whole_key(n)
        for batch in batches:
            rows = [(i, *k) for i, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for k in keys(n)]
            cols = list(zip(*rows)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.string()) for c in cols[1:])], names=["id", "brand", "sector", "second"])

    return written(spelled.mapInArrow(run, "id bigint, brand string, sector string, second string").distinct())


def _company_links(keyed: DataFrame) -> DataFrame:
    # Brands under six letters are near to none.
    close = radius_join(keyed.filter(F.length("brand") >= 6).select(F.col("sector").alias("block"), F.col("brand").alias("s")), 2)
    n = F.least(F.length("a"), F.length("b"))
    sure = close.filter(((F.col("d") == 1) & (n >= 6)) | ((F.col("d") == 2) & (n >= 6) & _swapped(F.col("a"), F.col("b")))).withColumn("check", F.lit(False))
    unsure = close.filter((F.col("d") == 2) & (n >= 8) & ~_swapped(F.col("a"), F.col("b"))).withColumn("check", F.lit(True))
    same = keyed.select(F.col("sector").alias("block"), F.col("brand").alias("a"), F.col("brand").alias("b")).distinct().withColumn("check", F.lit(False))
    links = sure.unionByName(unsure).select("block", "a", "b", "check").unionByName(same)
    classes = keyed.select("sector", "brand", "second").distinct()
    of = lambda x: classes.select(F.col("sector").alias("block"), F.col("brand").alias(x), F.col("second").alias(f"s{x}"), F.xxhash64("sector", "brand", "second").alias(f"class_{x}"))
    rows = links.join(of("a"), ["block", "a"]).join(of("b"), ["block", "b"]).filter("class_a <> class_b")
    kept = rows.filter(~F.col("check") | ((F.col("sa") == F.col("sb")) & (F.col("sa") != "")))
    # A second word that both have must agree, unless one spelling leaves it out.
    kept = kept.filter((F.col("sa") == "") | (F.col("sb") == "") | (F.col("sa") == F.col("sb")))
    return kept.select("class_a", "class_b").distinct()
