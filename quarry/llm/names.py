"""Problem 4: link the spellings of one company, subsidiary or person.

1. Spellings collapse to keys: accents, case, joined words, order, titles, legal forms,
   common abbreviations and nicknames are set aside.
2. Tokens that stand in few keys carry the identity.  Up to ``LONGEST`` letters they are
   paired by what is left of them after the allowed edits (exact), longer ones by MinHash
   bands over padded bigrams (``collision``), and verified by edit distance; each unproven
   token is anchored at its best proven neighbour.
3. Keys of one anchor are clustered by stars: the best supported key opens a star, keys
   similar to it by Monge-Elkan join the best star; keys that fit several (a bare first
   word, an initial) join none.  A person's bare word or word with initials looks through
   all stars with that word, not those of one core alone.
4. Initials of a company join by a shared identifier, else where only one star fits.
"""

from __future__ import annotations

import re
import unicodedata
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from quarry.core.runtime import cut, small_side

#: Tokens up to this length are paired without misses, longer ones by bands with this recall.
LONGEST, ROWS, RECALL = 20, 3, 0.99
#: Keys of one anchor beyond which a key is compared only with the centres that have a word like one of its own; the stars are the same.
GROUP = 4000
#: A token in so many keys, more than one entity has, is vocabulary in a table of any size: it is identity only in keys that have nothing else.
COMMON_KEYS = 12
#: Similarity from which keys are alike, and what an equal core adds.
MATCH, SAME_CORE = 0.84, 0.001
MATCH_SHARE = 1 - MATCH + 2 * SAME_CORE

# Parameters: legal forms, titles and what follows names.
LEGAL = frozenset("inc incorporated corp corporation ltd limited llc plc ag sa nv co company lp llp gmbh spa se aktiengesellschaft".split())
LEGAL_LONG = ("incorporated", "corporation", "limited", "company", "aktiengesellschaft")
LEGAL_PAIRS = frozenset({("group", "ltd"), ("grp", "ltd"), ("group", "limited"), ("grp", "limited"), ("holdings", "plc"), ("hldgs", "plc")})
TITLES = frozenset("mr mrs ms miss dr prof sir jr sr ii iii iv phd cfa esq md mba cpa".split())
# Parameter: abbreviations of words in company names.
SHORT = dict(x.split(":") for x in "aero:aerospace comps:components comp:components semi:semiconductor matls:materials mat:materials pharma:pharmaceutical labs:laboratories lab:laboratories mfg:manufacturing mfr:manufacturing intl:international natl:national frt:freight hldgs:holdings grp:group bros:brothers equip:equipment indl:industrial ind:industrial agri:agricultural agr:agricultural prods:products prod:products tech:technologies techs:technologies pkg:packaging sys:systems chem:chemicals chems:chemicals spec:specialty prec:precision instr:instruments instrs:instruments dev:devices med:medical ntwks:networks ntwk:networks svcs:services svc:services auto:automotive fin:financial hyd:hydraulic logist:logistics log:logistics elec:electric eng:engineering intrs:interiors ingr:ingredients cstgs:castings".split())
# Parameter: short forms of given names.
NICK = dict(x.split(":") for x in "gail:abigail abby:abigail alex:aleksandr sasha:aleksandr tony:anthony barney:barnaby chuck:charles charlie:charles dot:dorothy dolly:dolores lola:dolores ed:edward ned:edward eddie:edward ted:edward liz:elizabeth betty:elizabeth beth:elizabeth paco:francisco frank:francisco fritz:frederick fred:frederick freddy:frederick jerry:gerald gerry:gerald beppe:giuseppe lupe:guadalupe heinz:heinrich heiner:heinrich hank:henry harry:henry jim:james jimmy:james jamie:james hans:johannes jo:johannes pepe:jose josie:josefina pepa:josefina kate:katherine kathy:katherine katie:katherine kit:katherine ken:kenichiro larry:lawrence len:leonard leo:leonard lenny:leonard maggie:margaret meg:margaret peggy:margaret greta:margaret tilda:matilda mattie:matilda misha:mikhail nate:nathaniel nat:nathaniel seun:oluwaseun pat:patricia patty:patricia trish:patricia pri:priyanka becky:rebecca becca:rebecca rick:richard dick:richard rich:richard rob:robert bob:robert bobby:robert steph:stephanie steffi:stephanie sue:susannah susie:susannah suzy:susannah tom:thomas tommy:thomas uli:ulrike venkat:venkatesh venky:venkatesh mina:wilhelmina willa:wilhelmina billie:wilhelmina will:william bill:william billy:william zack:zacharias zach:zacharias zak:zacharias genia:yevgenia zhenya:yevgenia xiao:xiaoling chidi:chidinma cath:katherine renee:renee".split())


#: Letters that decompose to none of a to z.
_FOLD = str.maketrans({"ł": "l", "Ł": "L", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "ß": "ss", "æ": "ae", "Æ": "Ae", "œ": "oe", "Œ": "Oe", "þ": "th", "Þ": "Th", "ı": "i", "ħ": "h", "Ħ": "H"})


def plain(text: str) -> str:
    """Without accents, letters of other scripts kept whole."""
    t = unicodedata.normalize("NFKD", text.translate(_FOLD))
    return unicodedata.normalize("NFKC", "".join(c for c in t if not unicodedata.combining(c)))


def words_of(name: str) -> list[str]:
    """Lower-case words of any script; joined capitals are split, single letters with periods (S.A.) are joined."""
    t = plain(name)
    if " " not in t.strip() and re.search(r"[a-z][A-Z]", t):
        t = re.sub(r"(?<=[a-z])(?=[A-Z&])|(?<=&)(?=[A-Z])", " ", t)
        t = re.sub(r"(?<=[a-z])(and|of)(?= [A-Z])", r" \1", t)
    t = re.sub(r"[\"“”‘(][^\"“”’()]*[\"“”’)]", " ", t)
    t = re.sub(r"\b(?:[A-Za-z]\.\s?){2,}", lambda m: re.sub(r"[.\s]", "", m.group()) + " ", t)
    t = re.sub(r"\b([SN])\.? ?([AV])\.?(?=\s|$|,)", r"\1\2", t)
    return [w for w in re.split(r"[\W_]+", t.lower().replace("&", " ")) if w and w != "and"]


def osa(a: str, b: str, most: int) -> int:
    """Edit distance with transpositions, ``most + 1`` where it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last, now = None, list(range(len(b) + 1)), None
    for i, x in enumerate(a, 1):
        now = [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, now[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            now[j] = d
        if min(now) > most:
            return most + 1
        before, last = last, now
    return last[-1]


def allowed(n: int) -> int:
    return 0 if n < 4 else 1 if n < 6 else 2 if n < 12 else 3


def token_similarity(a: str, b: str) -> float:
    """1 for equal tokens, abbreviations and initials close to it, else by edit distance."""
    if a == b:
        return 1.0
    s, t = sorted((a, b), key=len)
    if len(s) == 1:
        return 0.9 if t[0] == s else 0.0
    if len(s) >= 3 and t.startswith(s):
        return 0.95
    if len(s) >= 3 and s[0] == t[0] and len(s) <= len(t) - 2 and _inside(s, t):
        return 0.88
    m = max(len(a), len(b))
    d = osa(a, b, max(allowed(m), m // 3))
    return max(0.0, 1 - d / m, 0.86 if d == 1 and m >= 3 else 0.0)


def _inside(s: str, t: str) -> bool:
    it = iter(t)
    return all(c in it for c in s)


def monge_elkan(a: list[str], b: list[str]) -> float:
    """Mean over the tokens of ``a`` of the best similarity in ``b``."""
    return sum(max((token_similarity(x, y) for y in b), default=0.0) for x in a) / len(a) if a else 1.0


def is_legal(w: str) -> bool:
    return w in LEGAL or len(w) >= 6 and any(osa(w, x, 3) <= min(3, len(x) // 4) for x in LEGAL_LONG)


def key_of(name: str, person: bool) -> tuple[str, str, str]:
    """``(sorted key, tokens in order, legal form)`` of a spelling."""
    w = words_of(name)
    if person:
        given = [NICK.get(x, x) for x in w if x not in TITLES]
        return " ".join(sorted(given)), " ".join(given), ""
    legal: list[str] = []
    out: list[str] = []
    for i, x in enumerate(w):
        nxt = w[i + 1] if i + 1 < len(w) else ""
        if (x in ("group", "grp") and (nxt in ("ltd", "limited") or nxt and is_legal(nxt))) or (x in ("holdings", "hldgs") and nxt == "plc"):
            legal.append(x)
        elif is_legal(x) and len(w) > 1:
            legal.append(x)
        else:
            out.append(SHORT.get(x, x))
    form = "".join({"incorporated": "inc", "corporation": "corp", "limited": "ltd", "company": "co", "grp": "group", "hldgs": "holdings", "aktiengesellschaft": "ag"}.get(x, x) for x in legal)
    return " ".join(sorted(out)), " ".join(out), form


def _keyed(rows: DataFrame) -> DataFrame:
    """``(name, person, key, tokens, form)`` of distinct names."""

    def run(it):
        for b in it:
            names, persons = b.column(0).to_pylist(), b.column(1).to_pylist()
            k = [key_of(n, p) for n, p in zip(names, persons)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array([x[i] for x in k], pa.string()) for i in range(3)]], ["name", "person", "key", "tokens", "form"])

    return rows.select("name", "person").mapInArrow(run, "name string, person boolean, key string, tokens string, form string")


def collision(jaccard: float, bands: int, rows: int = ROWS) -> float:
    """Chance that two tokens of this bigram similarity share a band."""
    return 1 - (1 - jaccard**rows) ** bands


def bands_for(length: int, edits: int, recall: float, rows: int = ROWS) -> int:
    """Fewest bands with which tokens of ``length`` letters that many edits apart meet with this chance; an edit changes two padded bigrams."""
    grams = length + 1
    bands, jaccard = 1, (grams - 2 * edits) / (grams + 2 * edits)
    while collision(jaccard, bands, rows) < recall:
        bands += 1
    return bands


def _bands(token: str, a: np.ndarray, b: np.ndarray) -> list[int]:
    t = f"^{token}$"
    g = np.array([ord(x) * 131071 + ord(y) for x, y in zip(t, t[1:])], np.uint64)
    h = ((g[:, None] * a[None, :] + b[None, :]) >> np.uint64(20)).min(0).reshape(BANDS, ROWS)
    mixed = (h * np.array([1_000_003, 998_244_353, 1], np.uint64)).sum(1) * np.uint64(0x9E3779B97F4A7C15) + np.arange(BANDS, dtype=np.uint64)
    return mixed.view(np.int64).tolist()


#: Bands of the shortest tokens that need them.
BANDS = bands_for(LONGEST - 2, allowed(LONGEST), RECALL)


def _edits(n: int) -> int:
    """Most edits to any token that one of ``n`` letters may be linked with."""
    return max(allowed(m) for m in range(n, n + 4) if m - n <= allowed(m)) if n > 1 else 0


def _shortened(token: str) -> dict[str, int]:
    """What is left of a token after up to ``_edits`` deletions, with the fewest deletions; tokens within that distance share one."""
    out = {token: 0}
    for k in range(1, min(_edits(len(token)), len(token) - 1) + 1):
        for drop in combinations(range(len(token)), k):
            out.setdefault("".join(c for i, c in enumerate(token) if i not in drop), k)
    return out


def _token_links(tokens: DataFrame) -> DataFrame:
    """``(a, b, d)``: tokens within typing distance, ``a`` unproven or not, ``b`` proven first."""

    def bands(it):
        rng = np.random.default_rng(4)
        a = rng.integers(1, 1 << 62, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        c = rng.integers(0, 1 << 62, BANDS * ROWS, dtype=np.uint64)
        for x in it:
            toks, ps = x.column(0).to_pylist(), x.column(1).to_pylist()
            t, p, h, k = [], [], [], []
            for tok, proven in zip(toks, ps):
                left = _shortened(tok) if len(tok) <= LONGEST else {}
                # Bands alone pair tokens beyond LONGEST; a shorter one needs them only near that length.
                hs = [str(v) for v in sorted(set(_bands(tok, a, c)))] if len(tok) > LONGEST - 3 else []
                t += [tok] * (len(hs) + len(left))
                p += [proven] * (len(hs) + len(left))
                h += [*hs, *left]
                k += [0] * len(hs) + list(left.values())
            yield pa.RecordBatch.from_arrays([pa.array(t, pa.string()), pa.array(p, pa.int64()), pa.array(h, pa.string()), pa.array(k, pa.int32())], ["token", "proof", "h", "k"])

    x = tokens.select("token", "proof").mapInArrow(bands, "token string, proof long, h string, k int")
    x = cut(x.withColumn("h", F.xxhash64("h")))
    a, b = x.where("proof < 3").alias("a"), x.alias("b")
    longer = F.greatest(F.length("a.token"), F.length("b.token"))
    most = F.when(longer < 4, 0).when(longer < 6, 1).when(longer < 12, 2).otherwise(3)
    near = (F.col("a.token") != F.col("b.token")) & (F.abs(F.length("a.token") - F.length("b.token")) <= most) & (F.greatest("a.k", "b.k") <= most) & (F.struct("b.proof", "b.token") > F.struct("a.proof", "a.token"))
    p = a.join(b, F.col("a.h") == F.col("b.h")).where(near).select(F.col("a.token").alias("a"), F.col("b.token").alias("b"), F.col("b.proof").alias("proof")).distinct()

    def check(it):
        for y in it:
            d = [osa(s, t, allowed(max(len(s), len(t)))) for s, t in zip(y.column(0).to_pylist(), y.column(1).to_pylist())]
            ok = [v <= allowed(max(len(s), len(t))) for v, s, t in zip(d, y.column(0).to_pylist(), y.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*y.columns, pa.array(d, pa.int32())], ["a", "b", "proof", "d"]).filter(pa.array(ok))

    return p.mapInArrow(check, "a string, b string, proof long, d int")


def _stars(it):
    """Star clustering of the keys of each anchor; a star is named by its centre's key.

    A group holds the distinct keys of one identity word, that is the misspellings of a
    handful of entities, not their mentions.
    """
    groups: dict = {}
    for b in it:
        for person, anchor, key, core, weight in zip(*[b.column(i).to_pylist() for i in range(5)]):
            groups.setdefault((person, anchor), []).append((-weight, key, core))
    people, keys, stars = [], [], []
    for (person, _), members in groups.items():
        for key, star in _cluster(sorted(members), person):
            people.append(person)
            keys.append(key)
            stars.append(star)
    yield pa.RecordBatch.from_arrays([pa.array(people, pa.bool_()), pa.array(keys, pa.string()), pa.array(stars, pa.string())], ["person", "key", "star"])


def _clustered(grouped: DataFrame) -> DataFrame:
    """``(person, key, star)`` of ``(person, anchor, key, core, weight)``; a group of any size is clustered in one pass."""
    return grouped.select("person", "anchor", "key", "core", "weight").repartition("person", "anchor").mapInArrow(_stars, "person boolean, key string, star string")


class _Centres:
    """The centres opened so far, by word.

    A mean of ``MATCH`` needs a word whose best partner is as similar as that: one that
    abbreviates the other or one within an edit, or within 16.2 % of its letters.  Only
    centres with such a word are named; centres always have words beside the core.
    """

    def __init__(self):
        self.having: dict[str, list[int]] = {}
        self.first: dict[str, list[str]] = {}
        self.left: dict[str, list[str]] = {}
        self.short: dict[str, tuple[int, list[str]]] = {}

    @staticmethod
    def _left(t: str) -> set[str]:
        """What is left of a word after as many deletions as edits may part it from a word that similar."""
        most = max(k for k in (1, *(int(MATCH_SHARE * m) for m in range(len(t), len(t) + 8) if m - len(t) <= int(MATCH_SHARE * m))))
        return {"".join(c for i, c in enumerate(t) if i not in drop) for k in range(min(most, len(t) - 1) + 1) for drop in combinations(range(len(t)), k)}

    def add(self, i: int, rest: list[str]) -> None:
        for t in set(rest):
            if t not in self.having:
                self.first.setdefault(t[0], []).append(t)
                for h in self._left(t):
                    self.left.setdefault(h, []).append(t)
            self.having.setdefault(t, []).append(i)

    def like(self, rest: list[str]) -> list[int]:
        """In the order of opening."""
        out: set[int] = set()
        for t in set(rest):
            known, near = self.short.get(t, (0, []))
            bucket = self.first.get(t[0], [])
            near += [w for w in bucket[known:] if _inside(*sorted((t, w), key=len))]
            self.short[t] = len(bucket), near
            for w in {*near, *(w for h in self._left(t) for w in self.left.get(h, ()))}:
                out.update(self.having[w])
        return sorted(out)


def _cluster(members: list[tuple], person: bool) -> list[tuple[str, str | None]]:
    """``(key, star)`` of keys by falling weight; no star where several fit a key alike."""
    rest = [[t for t in key.split() if t != core] for _, key, core in members]
    centres: list[int] = []
    index = _Centres() if len(members) > GROUP else None
    star: list[str | None] = [None] * len(members)
    for i, r in enumerate(rest):
        if not any(len(t) > 1 for t in r):
            continue
        best, score = i, MATCH
        for c in centres if index is None else index.like(r):
            s = _same(r, rest[c], person) + SAME_CORE * (members[i][2] == members[c][2])
            if s > score:
                best, score = c, s
        if best == i:
            centres.append(i)
            if index is not None:
                index.add(i, r)
        star[i] = members[best][1]
    for i, r in enumerate(rest):
        if star[i] is None:
            fits = [c for c in centres if _same(r, rest[c], person) >= MATCH]
            fits = [c for c in fits if members[c][2] == members[i][2]] or fits
            star[i] = members[fits[0]][1] if len(fits) == 1 else (None if fits else members[i][1])
    return [(m[1], s) for m, s in zip(members, star)]


def _same(a: list[str], b: list[str], person: bool) -> float:
    """How well the words beside the core agree; missing words do not count against it."""
    if person:
        x, y = [t for t in a if len(t) > 1], [t for t in b if len(t) > 1]
        if x and y:
            return min(monge_elkan(*sorted((x, y), key=len)), 1.0)
        x = [t for t in a if len(t) == 1]
        return 0.9 if not a or any(t[0] == y0[0] for t in x for y0 in y) else 0.0
    if not a or not b:
        return 0.9
    s, t = (a, b) if len(a) <= len(b) else (b, a)
    return monge_elkan(s, t)


def link_names(names: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """``(name, entity)``: every name with the key of its star; a name that fits no single star is an entity of its own.

    ``names``: ``(name, person, official)``, repeated rows add weight; null and blank names
    are left out.  ``ids``: ``(name, id)`` identifiers seen with a name, used for initials alone.
    """
    base = names.where("name is not null and trim(name) <> ''").groupBy("name").agg(F.max("person").alias("person"), F.max("official").alias("official"), F.count("*").alias("seen"))
    base = cut(base)
    keyed = cut(_keyed(base).join(base.select("name", "official", "seen"), "name").where("key <> ''"))
    initials = F.col("key").rlike("^[a-z]{2,5}$") & F.col("name").rlike(r"^[A-Z]{2,5}(?=[ ,]|$)") & ~F.col("person")
    keys = keyed.where(~initials).groupBy("person", "key").agg(F.count("*").alias("spellings"), F.max(F.col("official").cast("int")).alias("official"), F.sum("seen").alias("seen"))
    keys = cut(keys)
    toks = keys.select("person", "key", "spellings", "official", F.explode(F.array_distinct(F.split("key", " "))).alias("token")).where("length(token) > 1")
    df = toks.groupBy("person", "token").agg(F.count("*").alias("df"), F.sum("spellings").alias("forms"), F.max("official").alias("official"))
    common = cut(df.where(F.col("df") >= COMMON_KEYS).select("person", "token", F.lit(3).cast("long").alias("proof"), "forms", F.lit(True).alias("common")))
    rare = df.join(small_side(common.select("person", "token")), ["person", "token"], "left_anti")
    proof = F.when(F.col("official") > 0, 3).when((F.col("forms") >= 4) & (F.col("df") >= 2), 2).when(F.col("forms") >= 2, 1).otherwise(0)
    rare = cut(rare.select("person", "token", proof.cast("long").alias("proof"), "forms"))
    every = rare.withColumn("common", F.lit(False)).unionByName(common)
    links = [_token_links(every.where(c)).withColumn("person", F.lit(p)) for c, p in (("person", True), ("not person", False))]
    links = cut(links[0].unionByName(links[1]).join(every.select("person", F.col("token").alias("b"), "forms", "common"), ["person", "b"]))
    # Two proven tokens stay apart: a slip of the pen is never proven by several spellings and an official name at once.
    own = rare.select("person", F.col("token").alias("a"), F.col("proof").alias("own"), F.col("forms").alias("own_forms"))
    # A token next to a far more usual common one is that word misspelt, not identity, however often it is: it is core only where a key has nothing else.
    good = links.join(own, ["person", "a"]).where("own < 2 or (own < 3 and proof = 3 and forms >= 4 * own_forms)")
    best = good.withColumn("r", F.row_number().over(W.partitionBy("person", "a").orderBy("d", F.desc("proof"), F.desc("forms"), "b"))).where("r = 1")
    anchors = own.join(best.select("person", "a", "b", "common", "forms"), ["person", "a"], "left").select("person", F.col("a").alias("token"), F.coalesce("b", "a").alias("anchor"), F.when(F.col("common"), -1).otherwise(F.col("own")).alias("proof"), F.when(F.col("common"), F.col("forms")).otherwise(F.col("own_forms")).alias("forms"))
    # one more step for a token anchored at an anchored one
    up = anchors.select("person", F.col("token").alias("anchor"), F.col("anchor").alias("top"), F.col("proof").alias("anchor_proof"), F.col("forms").alias("anchor_forms"))
    anchors = cut(anchors.join(up, ["person", "anchor"], "left").select("person", "token", F.coalesce("top", "anchor").alias("anchor"), F.coalesce("anchor_proof", "proof").alias("ap"), F.coalesce("anchor_forms", "forms").alias("af")))
    # a key of nothing but common words has the least common of them for its core
    usual = common.select("person", "token", F.col("token").alias("anchor"), F.lit(-2).cast("long").alias("ap"), F.col("forms").alias("af"))
    own_word = F.col("ap") >= 0
    pick = W.partitionBy("person", "key").orderBy(F.desc(F.when(own_word, F.col("ap")).otherwise(-1)), F.desc(F.when(own_word, F.col("af")).otherwise(-F.col("af"))), F.desc(F.length("token")), "token")
    cores = toks.join(anchors.select("person", "token", "anchor", "ap", "af").unionByName(usual), ["person", "token"]).withColumn("r", F.row_number().over(pick)).where("r = 1")
    cores = cores.select("person", "key", F.col("token").alias("core"), "anchor")
    k = keys.join(cores, ["person", "key"], "left")
    lone = k.where("core is null").select("person", "key", F.col("key").alias("star"))
    weight = F.coalesce("official", F.lit(0)) * 1_000_000 + (F.col("core") == F.col("anchor")).cast("int") * 10_000 + F.least("spellings", F.lit(9_000)) + F.least("seen", F.lit(1_000_000)) / 2_000_000
    short = _short_keys(toks, anchors)
    grouped = k.where("core is not null").join(short.select(F.lit(True).alias("person"), "key"), ["person", "key"], "left_anti").withColumn("weight", weight.cast("double"))
    stars = _clustered(grouped)
    stars = cut(stars.unionByName(lone).where("star is not null"))
    stars = cut(stars.join(short.select(F.lit(True).alias("person"), "key"), ["person", "key"], "left_anti").unionByName(_short_stars(short, toks, anchors, stars)))
    linked = keyed.where(~initials).join(stars, ["person", "key"]).select("name", "person", "tokens", "form", "star", "seen")
    linked = cut(linked)
    out = linked.select("name", F.concat_ws(":", F.col("person").cast("string"), "star").alias("entity"))
    out = cut(out.unionByName(_initials(keyed.where(initials), linked, ids)))
    return out.unionByName(base.select("name").join(out.select("name"), "name", "left_anti").select("name", F.concat(F.lit("alone:"), F.col("name")).alias("entity")))


def _anchored(toks: DataFrame, anchors: DataFrame) -> DataFrame:
    """``(key, token, anchor, words)`` of persons; a common token is its own anchor."""
    a = anchors.where("person").select("token", "anchor")
    x = toks.where("person").select("key", "token").join(a, "token", "left").select("key", "token", F.coalesce("anchor", "token").alias("anchor"))
    return x.withColumn("words", F.count("*").over(W.partitionBy("key")))


def _short_keys(toks: DataFrame, anchors: DataFrame) -> DataFrame:
    """``(key, token, anchor, letters)`` of persons named by one word alone or with initials."""
    letters = F.filter(F.split("key", " "), lambda w: F.length(w) == 1).alias("letters")
    return cut(_anchored(toks, anchors).where("words = 1").select("key", "token", "anchor", letters))


def _short_stars(short: DataFrame, toks: DataFrame, anchors: DataFrame, stars: DataFrame) -> DataFrame:
    """``(person, key, star)``: the only star with this word, whichever of its words is its core, and an initial; none where several fit."""
    centre = stars.where("person and key = star").select("key")
    other = F.filter(F.array_distinct(F.split("key", " ")), lambda w: (F.length(w) > 1) & (w != F.col("token")))
    full = _anchored(toks, anchors).where("words > 1").join(centre, "key").select(F.col("key").alias("star"), F.col("token").alias("word"), "anchor", F.transform(other, lambda w: F.substring(w, 1, 1)).alias("firsts"))
    fits = short.join(full, "anchor").where("size(letters) = 0 or arrays_overlap(letters, firsts)").groupBy("key").agg(
        F.min("star").alias("low"), F.max("star").alias("high"), F.min(F.when(F.col("token") == F.col("word"), F.col("star"))).alias("same_low"), F.max(F.when(F.col("token") == F.col("word"), F.col("star"))).alias("same_high")
    )
    one = F.when(F.col("low").isNull(), F.col("key")).when(F.col("same_low").isNull() & (F.col("low") == F.col("high")), F.col("low")).when(F.col("same_low") == F.col("same_high"), F.col("same_low"))
    return short.join(fits, "key", "left").select(F.lit(True).alias("person"), "key", one.alias("star")).where("star is not null")


def _initials(short: DataFrame, linked: DataFrame, ids: DataFrame | None) -> DataFrame:
    """Initials of companies: the star that shares an identifier, else the only one with these initials and form."""
    entity = F.concat(F.lit("false:"), F.col("star")).alias("entity")
    org = linked.where("not person")
    letters = F.array_join(F.transform(F.split("tokens", " "), lambda t: F.substring(t, 1, 1)), "")
    group = F.when(F.col("form").startswith("group"), F.concat(letters, F.lit("g"))).when(F.col("form").startswith("holdings"), F.concat(letters, F.lit("h"))).otherwise(letters)
    full = org.where("size(split(tokens, ' ')) >= 2 and tokens not rlike '(^| )[a-z]( |$)'")
    stars = full.select(entity, F.explode(F.array_distinct(F.array(letters, group))).alias("key"), "form", "seen").groupBy("entity", "key", "form").agg(F.sum("seen").alias("seen"))
    s = short.select("name", "key", "form")
    fits = s.join(stars.withColumnRenamed("form", "sform"), "key").where("form = '' or form = sform").select("name", "entity").distinct()
    only = fits.withColumn("n", F.count("*").over(W.partitionBy("name"))).where("n = 1").select("name", "entity")
    if ids is None:
        return only
    i = ids.where("name is not null and id is not null").distinct()
    by_id = i.join(org.select("name", entity), "name").groupBy("id", "entity").agg(F.count("*").alias("k"))
    seen = s.join(i, "name").join(by_id, "id").join(fits, ["name", "entity"]).groupBy("name", "entity").agg(F.sum("k").alias("k"))
    told = seen.withColumn("r", F.row_number().over(W.partitionBy("name").orderBy(F.desc("k"), "entity"))).where("r = 1").select("name", "entity")
    return told.unionByName(only.join(told.select("name"), "name", "left_anti"))


def pairs_of(entities: DataFrame) -> DataFrame:
    """``(name_a, name_b)``, smaller first by code point, of different names of one entity."""
    a, b = entities.alias("a"), entities.alias("b")
    return a.join(b, "entity").where("a.name < b.name").select(F.col("a.name").alias("name_a"), F.col("b.name").alias("name_b")).distinct()


def names_from(triples: DataFrame, constituents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Names of companies, subsidiaries and persons with their kind, and identifiers seen with them."""
    ends = [triples.select(F.col(f"{x}_name").alias("name"), F.col(f"{x}_type").alias("kind"), F.col(f"{x}_ticker").alias("ticker"), F.col(f"{x}_cik").alias("cik"), F.lit(False).alias("official")) for x in ("source", "target")]
    listed = constituents.select(F.col("company_name").alias("name"), F.lit("Company").alias("kind"), "ticker", "cik", F.lit(True).alias("official"))
    x = ends[0].unionByName(ends[1]).unionByName(listed).where("kind in ('Company', 'Subsidiary', 'Person')")
    names = x.select("name", (F.col("kind") == "Person").alias("person"), "official")
    idents = F.array(F.concat(F.lit("t:"), F.upper("ticker")), F.concat(F.lit("c:"), F.lpad(F.regexp_replace("cik", "^0+", ""), 10, "0")))
    return names, x.select("name", F.explode(idents).alias("id")).where("id is not null").distinct()
