"""Problem 4: address records of the same location, matched from the region down to the unit.

An address is parsed into parts whatever their order. Then it is placed level by level. Region:
the country by its notation, the state as given, or as the other addresses of its post code and
place, or of its place, give it if they agree. Locality: post codes and places of a region name
each other (the majority decides, typing errors go to the place they are near to). Street: within
a place the spellings of a street gather around the most frequent one where their numbers meet.
Number and unit must be equal. A missing level inherits all candidates of the level above: an
address without its place keeps all places that have such a street and number, and takes one
over only if its post code or their number leaves a single one; otherwise it stays open, its
candidates are listed by :func:`candidates`, and it links only to what has the same post code,
number and street.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.runtime import materialize, salted_join

# Abbreviations of street types, directions and states.
TYPES = {"street": "street", "st": "street", "str": "street", "avenue": "avenue", "ave": "avenue", "av": "avenue", "road": "road", "rd": "road", "drive": "drive", "dr": "drive", "lane": "lane", "ln": "lane", "court": "court", "ct": "court", "crt": "court", "place": "place", "pl": "place", "square": "square", "sq": "square", "terrace": "terrace", "ter": "terrace", "terr": "terrace", "boulevard": "boulevard", "blvd": "boulevard", "boul": "boulevard", "highway": "highway", "hwy": "highway", "parkway": "parkway", "pkwy": "parkway", "pky": "parkway", "way": "way", "circle": "circle", "cir": "circle", "trail": "trail", "trl": "trail", "alley": "alley", "aly": "alley"}
DIRECTIONS = {"n": "n", "north": "n", "s": "s", "south": "s", "e": "e", "east": "e", "w": "w", "west": "w"}
STATES = dict(p.split(":") for p in "alabama:al alaska:ak arizona:az arkansas:ar california:ca colorado:co connecticut:ct delaware:de florida:fl georgia:ga hawaii:hi idaho:id illinois:il indiana:in iowa:ia kansas:ks kentucky:ky louisiana:la maine:me maryland:md massachusetts:ma michigan:mi minnesota:mn mississippi:ms missouri:mo montana:mt nebraska:ne nevada:nv new_hampshire:nh new_jersey:nj new_mexico:nm new_york:ny north_carolina:nc north_dakota:nd ohio:oh oklahoma:ok oregon:or pennsylvania:pa rhode_island:ri south_carolina:sc south_dakota:sd tennessee:tn texas:tx utah:ut vermont:vt virginia:va washington:wa west_virginia:wv wisconsin:wi wyoming:wy".split())
CODES = set(STATES.values())
COUNTRIES = r"\b(?:u\.?s\.?a\.?|united states|deutschland|germany|alemania|españa|espana|spain|france|francia|frankreich)\b\.?"

#: Share of the addresses of a post code that must name its place.
MAJORITY = 0.5
#: A spelling of a place gives way to one that is this many times as frequent.
TIMES = 4


def plain(s: str) -> str:
    s = s.replace("ß", "ss").replace("ẞ", "ss")
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).lower()


_UNIT = re.compile(r"(?:\b(?:apartment|apart|apt|unit|suite|ste)\b\W*|#\s*)(\d+[a-z]?|[a-z]\d*)\b")
_BOX = re.compile(r"\b(?:p\W{0,2}o\W{0,2}\s?box|pob|p\.?o\.?b\.?|post\s+office\s+box|postfach|apartado)\W*(\d+)")
_STATION = re.compile(r"([^\W\d_]+)\W+(?:station|stn|sta)\b")
_GERMAN = re.compile(r"\b([^\W\d_]+?)-?(?:strasse|str)\b\W*(\d+[a-z]?)\b")
_FRENCH = re.compile(r"\b(\d+)(?:\s*(?:bis|ter))?\W+(?:rue|r)\b\W+(?:(?:de la|des|du|de|la|le|les)\s+|[dl]['’])?([^\W\d_]+(?:-[^\W\d_]+)*)")
_SPANISH = re.compile(r"\b(?:calle|cl|c)\b[\W]+(?:(?:de la|de los|de|del|la)\s+)?([^\W\d_]+)\W+(?:n[oº°]?\W*)?(\d+)\b")


#: A number with a street and its type right behind is no post code.
_STREET_BEHIND = re.compile(r"\s+(?:(?:[nsew]|north|south|east|west)\.?\s+)?(?:(?!(?:[nsew]|north|south|east|west)\b)[^\W\d_]+\s+){1,3}?(?:" + "|".join(sorted(TYPES, key=len, reverse=True)) + r")\b")


def parse(address: str | None) -> tuple[str, str, str, str, str, str, str, str, str] | None:
    """kind, number, unit, direction, street, type, city, state, zip; '' for what is missing. None if there is neither number nor street."""
    if not address or not address.strip():
        return None
    s = re.sub(COUNTRIES, " ", plain(address))
    s = s.replace("nº", " ").replace("n°", " ")
    unit = ""
    m = _UNIT.search(s)
    if m:
        unit = m[1]
        s = s[: m.start()] + " , " + s[m.end() :]
    zip5 = ""
    z = [m for m in re.finditer(r"\b\d{5}(?:-\d{4})?\b", s) if not _STREET_BEHIND.match(s, m.end())]
    if z:
        zip5 = z[-1].group()[:5]
        s = s[: z[-1].start()] + " ; " + s[z[-1].end() :]
    kind = number = direction = street = type_ = ""
    if m := _BOX.search(s):
        kind, number = "box", m[1]
        s = s[: m.start()] + " , " + s[m.end() :]
        if m := _STATION.search(s):
            street = m[1]
            s = s[: m.start()] + " , " + s[m.end() :]
    elif m := _SPANISH.search(s):
        kind, street, number = "es", m[1], m[2]
        s = s[: m.start()] + " , " + s[m.end() :]
    elif m := _FRENCH.search(s):
        kind, street, number = "fr", m[2], m[1]
        s = s[: m.start()] + " , " + s[m.end() :]
    elif m := _GERMAN.search(s):
        kind, street, number = "de", m[1], m[2]
        s = s[: m.start()] + " , " + s[m.end() :]
    elif m := re.search(r"(?<![\w-])(\d+(?:-\d+)?[a-z]?)(?!\w)", s):
        kind, number = "us", m[1]
        before, after = s[: m.start()], s[m.end() :]
        parts = [w for w in re.split(r"([,;()]|\s-\s|\s+|\.)", after) if w and w.strip() or w == ","]
        words = [w.strip() for w in parts if w.strip() and w.strip() != "."]
        i = 0
        if words and words[0] in DIRECTIONS and len(words) > 1:
            direction, i = DIRECTIONS[words[0]], 1
        end = next((k for k in range(i, len(words)) if words[k] in ",;()-"), len(words))
        typed = next((k for k in range(i + 1, min(end, i + 4)) if words[k] in TYPES), None)
        if typed is not None and typed - i >= 2 and words[typed] in CODES:
            typed = None  # a street without its type, a place and its state
            end = i + 1
        if typed is not None:
            street, type_ = " ".join(words[i:typed]), TYPES[words[typed]]
            rest = words[typed + 1 :]
        else:
            stop = end if end < len(words) and end - i <= 2 and not any(w in CODES or w in STATES for w in words[i + 1 : end]) else i + 1
            street, rest = " ".join(words[i:stop]), words[stop:]
            rest = rest if stop else []
        s = before + " , " + " ".join(rest)
    else:
        return None
    words = re.findall(r"[^\W\d_]+", s)
    state = ""
    for k in range(len(words) - 1, -1, -1):
        two = "_".join(words[k : k + 2])
        if two in STATES:
            state = STATES[two]
            del words[k : k + 2]
            break
        if words[k] in STATES or words[k] in CODES and kind in ("us", "box"):
            state = STATES.get(words[k], words[k])
            del words[k]
            break
    if kind == "us" and not type_ and words and words[0] in TYPES:
        type_ = TYPES[words.pop(0)]
    return kind, number, unit, direction, street, type_, " ".join(words), state, zip5


FIELDS = ("kind", "number", "unit", "direction", "street", "type", "city", "state", "zip")


def near(a: str, b: str, most: int) -> bool:
    """At most ``most`` insertions, deletions, substitutions or swaps of neighbours apart."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > most:
        return False
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if max(len(a), len(b)) <= most:
        return True
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return False
        two, one = one, row
    return one[-1] <= most


def tolerance(a: str) -> int:
    return 0 if len(a) < 4 else 1 if len(a) < 6 else 2


def address_records(roster_rows: DataFrame, extractions: DataFrame) -> DataFrame:
    """address_id, address: roster rows with an address and extractions of category home_address. Null ids and values are left out."""
    r = roster_rows.select(F.col("row_id").alias("address_id"), F.col("home_address").alias("address"))
    e = extractions.where("category = 'home_address'").select(F.col("id").alias("address_id"), F.col("normalized_value").alias("address"))
    return r.unionByName(e).where("address_id is not null and address is not null")


def parsed(records: DataFrame) -> DataFrame:
    """address_id and the parts of every record; an address without any number keeps its text as street, so that it links to its equals only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [parse(a) or ("text", "", "", "", " ".join(re.findall(r"\w+", plain(a))), "", "", "", "") for a in b.column(1).to_pylist()]
            cols = list(zip(*rows)) if rows else [[]] * len(FIELDS)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.string()) for c in cols)], ["address_id", *FIELDS])

    return records.select(F.col("address_id").cast("bigint"), "address").mapInArrow(run, "address_id bigint, " + ", ".join(f"{f} string" for f in FIELDS))


def _variants(df: DataFrame, column: str) -> DataFrame:
    """Rows repeated for every deletion of ``column``, in ``v``; all in the JVM."""
    c = F.col(column)
    places = F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1)))
    cut = F.transform(places, lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))
    return df.withColumn("v", F.explode(F.array_distinct(F.concat(F.array(c), cut))))


def place_names(forms: DataFrame) -> DataFrame:
    """city spelling -> place: the most frequent spelling one error away if it is TIMES times as frequent, else itself. The states must not differ."""
    named = forms.where("city <> ''")
    by_city = materialize(named.groupBy("city").agg(F.sum("n").alias("n"), F.max_by("state", F.struct(F.when(F.col("state") == "", 0).otherwise(F.col("n")), "state")).alias("state")))
    a = _variants(by_city.where(F.length("city") > 4).select("city", "n", F.col("state").alias("s")), "city")
    b = _variants(by_city.where((F.length("city") > 4) & (F.col("n") >= TIMES)).select(F.col("city").alias("place"), F.col("n").alias("m"), F.col("state").alias("t")), "place")
    close = a.join(b, "v").where((F.col("m") >= TIMES * F.col("n")) & (F.levenshtein("city", "place") <= 2) & ((F.col("s") == F.col("t")) | (F.col("s") == "") | (F.col("t") == "")))
    return by_city.join(close.groupBy("city").agg(F.max_by("place", F.struct("m", "place")).alias("place")), "city", "left").select("city", F.coalesce("place", "city").alias("place"))


def _agreed(forms: DataFrame, keys: list[str], share: float, name: str) -> DataFrame:
    """``keys`` -> ``name``: the state that at least ``share`` of the addresses that give one agree on."""
    n = forms.where("state <> '' and region = 'us'").groupBy(*keys, "state").agg(F.sum("n").alias("n"))
    top = n.groupBy(*keys).agg(F.max_by("state", F.struct("n", "state")).alias(name), F.max("n").alias("top"), F.sum("n").alias("all"))
    return top.where(F.col("top") >= share * F.col("all")).select(*keys, name)


def located(forms: DataFrame) -> DataFrame:
    """``forms`` with region (the country), place and state: the place of the city, corrected by its post code within the region if they are near, null without a city; the state as given, or that of its post code and place, or that of its place if it is in one state only."""
    f = forms.withColumn("region", F.when(F.col("kind") == "box", "us").otherwise(F.col("kind")))
    f = materialize(salted_join(f, place_names(forms).withColumnRenamed("place", "cp"), ["city"], "left"))
    zc = f.where("zip <> '' and cp is not null").groupBy("region", "zip", "cp").agg(F.sum("n").alias("n"))
    by_zip = zc.groupBy("region", "zip").agg(F.max_by("cp", F.struct("n", "cp")).alias("zp"), F.max("n").alias("top"), F.sum("n").alias("all")).where(F.col("top") >= MAJORITY * F.col("all")).select("region", "zip", "zp")
    f = salted_join(f, materialize(by_zip), ["region", "zip"], "left")
    near_zip = F.levenshtein("cp", "zp") <= F.when(F.length("cp") < 6, 1).otherwise(2)
    f = materialize(f.withColumn("place", F.when(F.col("zp").isNotNull() & near_zip, F.col("zp")).otherwise(F.col("cp"))).drop("zp", "cp"))
    f = salted_join(f, materialize(_agreed(f.where("zip <> '' and place is not null"), ["zip", "place"], MAJORITY, "s1")), ["zip", "place"], "left")
    f = salted_join(f, materialize(_agreed(f.where("place is not null"), ["place"], 1.0, "s2")), ["place"], "left")
    return f.withColumn("own", F.when((F.col("region") == "us") & (F.col("state") == ""), F.coalesce("s1", "s2", F.lit(""))).otherwise(F.col("state"))).drop("s1", "s2")


def gather(spellings: list[tuple[str, str, str, str, int]]) -> list[int]:
    """Which of the spellings (street, direction, type, state, how often) of one place, number and unit are one location: index of its leading spelling."""
    order = sorted(range(len(spellings)), key=lambda i: (-spellings[i][4], spellings[i][:4] == ("", "", "", ""), spellings[i][:4]))
    order.sort(key=lambda i: (not spellings[i][1], not spellings[i][2]))  # complete ones lead
    leads: list[int] = []
    index: dict[str, list[int]] = {}  # what is left of a leading street without letters -> the leads
    many = len(spellings) > FEW
    out = [0] * len(spellings)
    for i in order:
        s = spellings[i]
        near_ = sorted({j for v in _without(s[0], 2) for j in index.get(v, ())}) if many else leads
        fits = [j for j in near_ if fit(spellings[j], s)]
        exact = [j for j in fits if spellings[j][0] == s[0]] or fits
        if len(exact) == 1 or len(exact) > 1 and len({spellings[j][0] for j in exact}) > 1:
            out[i] = min(exact, key=lambda j: (-spellings[j][4], spellings[j][:4]))
        elif exact and all(spellings[j][1:3] == s[1:3] for j in exact):
            out[i] = exact[0]
        else:
            leads.append(i)
            out[i] = i
            if many:
                for v in _without(s[0], tolerance(s[0])):
                    index.setdefault(v, []).append(i)
    return out


#: Spellings of a block that are compared with each other without an index.
FEW = 12


def _without(word: str, most: int) -> set[str]:
    """``word`` and what is left of it without up to ``most`` letters: words that few changes apart share one."""
    out = now = {word}
    for _ in range(most):
        now = {w[:i] + w[i + 1 :] for w in now for i in range(len(w))}
        out = out | now
    return out


def fit(a: tuple, b: tuple) -> bool:
    return near(a[0], b[0], tolerance(a[0])) and (not a[1] or not b[1] or a[1] == b[1]) and (not a[2] or not b[2] or a[2] == b[2]) and (not a[3] or not b[3] or a[3] == b[3])


def _led(spelt: DataFrame, block: list[str]) -> DataFrame:
    """Spellings of each block with their location and its leading spelling. A block holds the different spellings of one place, number and unit, however many records they have."""
    groups = spelt.groupBy(*block).agg(F.collect_list(F.struct("street", "direction", "type", "own", "n")).alias("s"))
    names = [*block, "street", "direction", "type", "own", "location", "l_street", "l_direction", "l_type", "l_state"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for *key, s in zip(*(b.column(k).to_pylist() for k in range(len(block) + 1))):
                s = sorted((x["street"], x["direction"], x["type"], x["own"], x["n"]) for x in s)
                for x, lead in zip(s, gather(s)):
                    name = hashlib.md5("\0".join([*key, *s[lead][:4]]).encode()).hexdigest()
                    rows.append((*key, *x[:4], name, *s[lead][:4]))
            cols = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names)

    return groups.mapInArrow(run, ", ".join(f"{n} string" for n in names))


SPELLING = ["street", "direction", "type", "own"]


def _matched(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Forms (FIELDS) with their location, and the candidates (FIELDS, location, score) of forms without a place."""
    forms = materialize(rows.groupBy(*FIELDS).agg(F.count(F.lit(1)).alias("n")))
    f = materialize(located(forms))
    block = ["kind", "number", "unit", "place"]
    led = materialize(_led(f.where("place is not null").groupBy(*block, *SPELLING).agg(F.sum("n").alias("n")), block))
    placed = materialize(f.where("place is not null").join(led.select(*block, *SPELLING, "location", "l_street", "l_direction", "l_type", "l_state"), [*block, *SPELLING]))
    # without a city: candidates are the locations with such a number, unit and street, of any place; the post code decides
    bare = f.where("place is null").select(*FIELDS, "own", "n")
    hubs = _variants(placed.select("kind", "number", "unit", "location", "l_street", "l_direction", "l_type", "l_state", F.col("zip").alias("l_zip")).distinct(), "l_street")
    swapped = (F.levenshtein("zip", "l_zip") <= 1) | (F.array_sort(F.split("zip", "")) == F.array_sort(F.split("l_zip", ""))) & (F.levenshtein("zip", "l_zip") == 2)
    score = F.when((F.col("zip") == "") | (F.col("zip") == F.col("l_zip")), 2).when((F.col("l_zip") != "") & swapped, 1).when((F.col("l_zip") == "") & (F.col("state") != "") & (F.col("state") == F.col("l_state")), 1).otherwise(0)
    tried = (
        _variants(bare, "street").join(hubs, ["kind", "number", "unit", "v"])
        .where("(direction = '' or l_direction = '' or direction = l_direction) and (type = '' or l_type = '' or type = l_type) and (state = '' or l_state = '' or state = l_state)")
        .withColumn("score", score).where("score > 0")
        .groupBy(*FIELDS, "location").agg(F.max("score").alias("score"))
    )
    tried = materialize(tried)
    best = tried.groupBy(*FIELDS).agg(F.max("score").alias("score"))
    top = materialize(tried.join(best, [*FIELDS, "score"]))
    one = top.groupBy(*FIELDS).agg(F.count(F.lit(1)).alias("k"), F.min("location").alias("location")).where("k = 1").drop("k")
    taken = materialize(bare.join(one, list(FIELDS), "left"))
    # what stays open links to what has the same post code, number, unit and street
    zblock = ["kind", "number", "unit", "zip"]
    rest = taken.where("location is null")
    own = _led(rest.groupBy(*zblock, *SPELLING).agg(F.sum("n").alias("n")), zblock)
    opened = rest.drop("location").join(own.select(*zblock, *SPELLING, "location"), [*zblock, *SPELLING])
    every = placed.select(*FIELDS, "location").unionByName(taken.where("location is not null").select(*FIELDS, "location")).unionByName(opened.select(*FIELDS, "location"))
    return every, top.join(rest.select(*FIELDS), list(FIELDS), "left_semi")


def locations(records: DataFrame) -> DataFrame:
    """address_id, location: equal locations for the records of one place, number, street and unit."""
    rows = materialize(parsed(records))
    return salted_join(rows, materialize(_matched(rows)[0]), list(FIELDS)).select("address_id", "location")


def candidates(records: DataFrame) -> DataFrame:
    """The open addresses, one row a notation and candidate: address_id (the smallest record written so), records (how many are), location and score of a place that it may mean."""
    rows = materialize(parsed(records))
    open_ = materialize(_matched(rows)[1])
    ids = rows.groupBy(*FIELDS).agg(F.min("address_id").alias("address_id"), F.count(F.lit(1)).alias("records"))
    return ids.join(open_, list(FIELDS)).select("address_id", "records", "location", "score")


def pairs(records: DataFrame) -> DataFrame:
    """address_id_a, address_id_b of every two records of one location; what the problem asks for are all pairs, so their number is that of the result."""
    at = materialize(locations(records))
    a = at.select(F.col("address_id").alias("address_id_a"), "location")
    b = at.select(F.col("address_id").alias("address_id_b"), "location")
    return a.join(b, "location").where("address_id_a < address_id_b").select("address_id_a", "address_id_b")
