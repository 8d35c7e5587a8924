"""PII by boosted trees over candidate spans, in DataFrame functions only.

Base patterns give their spans outright.  High-recall generators propose further, overlapping spans in looser formats
(bracketed addresses, national phone numbers, cards with unusual separators, IPv6 ...) and of further kinds: secrets
(values assigned to a token, key or password, and keys of well-known forms) and ids (IBANs, social security numbers).
Each candidate's format and context become a bit pattern; gradient-boosted trees of depth two over those bits score it,
and a threshold per kind, calibrated for precision on held-out examples, selects it.  A selected span that meets a base
span gives way unless it holds that span whole, and so it does to a better candidate that it meets.

The trees are trained in the driver on ``examples()``, a fixed number of generated sentences with known spans, through
the same DataFrame feature code; only a histogram of bit patterns (at most 2**len(BITS) rows, a few hundred in practice)
is gathered.  The model becomes a SQL expression, so the corpus is read once, without a shuffle.

Offsets count code points.  Patterns match whole runs however long (no upper bound cuts a secret or an address;
look-behinds stop restarts inside a run, possessive groups never recurse), so long texts take linear time.

Defined results: null text has no span; repeated rows are judged one by one; of candidates that tie, the first and then the
longest stays; input columns ``base`` and ``found`` are replaced by the results.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "secret", "id")
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:@|[(\[{]\x20?at\x20?[)\]}]|\x20at\x20)\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[(\[{]\x20?dot\x20?[)\]}]|\x20dot\x20)\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|[0-9]{1,3}(?:\x20?[(\[]\.[)\]]\x20?[0-9]{1,3}){3}|[0-9]{1,3}(?:\x20\.\x20?[0-9]{1,3}){3})(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}(?:[\x20._/-]{1,3}[0-9]{4}){3}(?![0-9])|(?<![0-9])[0-9]{4}[._/][0-9]{6}[._/][0-9]{5}(?![0-9])",
    "phone": r"(?<![0-9+])(?:00[1-9][0-9\x20()./-]{7,18}[0-9]|\(?[0-9]{3}\)?[\x20./-]{1,2}[0-9]{3}[\x20./-][0-9]{4}|0[0-9]{2,4}[\x20/-][0-9]{3,4}[\x20-]?[0-9]{3,5})(?![0-9])",
    "secret": r"(?i)(?<=(?:token|secret|key|password|passwd|pwd|passphrase)[\x22']?\x20{0,2}[=:]\x20{0,2}[\x22']?)[A-Za-z0-9_+/.!$%-]{6,}+=*|(?-i:\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|sk-[A-Za-z0-9]{20,}+|xox[abpr]-[A-Za-z0-9-]{10,}+)\b)|\b[0-9a-f]{32,}+\b",
    "id": r"(?<![0-9A-Za-z-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)(?![0-9A-Za-z-])",
}
#: What a text must contain for any pattern of a kind to match; plain scans that spare most texts the patterns.
GATE = {"email": r"@|(?i:[(\[{]\x20?at\x20?[)\]}]|\x20at\x20)", "ip": r"[0-9A-Fa-f][:.()\[\]\x20]", "card": r"[0-9]", "phone": r"[0-9]",
        "secret": r"(?i)(?:token|secret|key|password|passwd|pwd|passphrase)[\x22']?\x20{0,2}[=:]|AKIA|gh[pousr]_|sk-|xox|[0-9a-f]{32}", "id": r"[0-9]{3}-[0-9]{2}-|[A-Z]{2}[0-9]{2}"}
CONTEXT = {
    "email": r"(?i)(?:mail|contact|write|reach|kontakt|correo|courriel)",
    "ip": r"(?i)(?:\bip\b|host|server|address|login|addr|from)",
    "card": r"(?i)(?:card|visa|master|credit|debit|amex|carte|karte|tarjeta|pay)",
    "phone": r"(?i)(?:phone|call|tel|mobile|fax|cell|dial|whatsapp|sms)",
    "secret": r"(?i)(?:token|secret|key|passw|pwd|passphrase|auth|bearer|credential)",
    "id": r"(?i)(?:iban|ssn|social|account|konto|cuenta|compte|bank)",
}
DECOY = r"(?i)(?:order|invoice|version|isbn|issn|serial|sku|part|model|ref|price|total|build|release|chapter|section|lot|batch|tracking)[\x20:#.]*(?:no\.?|number|id)?[\x20:#.]*$"
BITS = ("email", "ip", "card", "phone", "luhn", "phone_digits", "octets", "context", "decoy", "glued", "issuer", "prefix", "spelled", "tld", "grouped", "v6", "secret", "id", "hex", "mixed", "iban")


def located(text: Column, pattern: str, kind: str) -> Column:
    """Matches of a pattern, leftmost and non-overlapping: array<struct<start, end, kind, match>>."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    empty = F.array().cast("array<struct<start:int,end:int,kind:string,match:string>>")
    walk = F.aggregate(
        F.zip_with(F.slice(between, 1, F.size(found)), found, lambda b, m: F.struct(F.length(b).alias("gap"), m.alias("match"))),
        F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda s, x: F.struct(
            (s["at"] + x["gap"] + F.length(x["match"])).alias("at"),
            F.concat(s["out"], F.array(F.struct((s["at"] + x["gap"]).alias("start"), (s["at"] + x["gap"] + F.length(x["match"])).alias("end"), F.lit(kind).alias("kind"), x["match"].alias("match")))).alias("out"),
        ),
        lambda s: s["out"],
    )
    return walk


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = F.reverse(_digits(m))
    n = F.length(d)
    twice = lambda v: F.when(v > 9, v - 9).otherwise(v)
    total = F.aggregate(
        F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.when(i % 2 == 0, twice(2 * F.substr(d, i, F.lit(1)).cast("int"))).otherwise(F.substr(d, i, F.lit(1)).cast("int"))),
        F.lit(0), lambda s, v: s + F.coalesce(v, F.lit(0)),
    )
    return F.when((n >= 12) & (n <= 19), total % 10 == 0).otherwise(F.lit(False))


def _iban(m: Column) -> Column:
    """Whether the check digits of an IBAN hold: letters count as 10 to 35, and the number leaves 1 by 97."""
    s = F.regexp_replace(m, r"\x20", "")
    turned = F.concat(F.substr(s, F.lit(5), F.length(s)), F.left(s, F.lit(4)))
    code = lambda c: F.ascii(c) - F.when(F.ascii(c) >= 65, 55).otherwise(48)
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(F.when(code(c) >= 10, a * 100 + code(c)).otherwise(a * 10 + code(c)) % 97))
    return m.rlike("^[A-Z]{2}[0-9]{2}") & (F.length(s) >= 15) & (rest == 1)


def _octets(m: Column) -> Column:
    part = F.split(F.regexp_replace(m, r"[^0-9.]", ""), r"\.")
    return (F.size(part) == 4) & F.forall(part, lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.length(p) > 0) & (F.coalesce(F.right(p, F.lit(9)).cast("int"), F.lit(999)) <= 255))


def base_spans(text: Column) -> Column:
    """All base spans by start, then kind."""
    valid = {"email": lambda x: F.lit(True), "ip": lambda x: _octets(x["match"]), "card": lambda x: _luhn(x["match"]), "phone": lambda x: F.length(_digits(x["match"])).between(9, 15)}
    gate = {"email": "@", "ip": ".", "card": None, "phone": "+"}
    none = F.array().cast("array<struct<start:int,end:int,kind:string,match:string>>")
    each = []
    for kind in BASE:
        held = F.contains(text, F.lit(gate[kind])) if gate[kind] else F.lit(True)
        if kind != "email":
            held = held & text.rlike("[0-9]")
        each.append(F.when(held, F.filter(located(text, BASE[kind], kind), valid[kind])).otherwise(none))
    return ordered(F.concat(*each))


def ordered(spans: Column) -> Column:
    rank = {k: i for i, k in enumerate(KINDS)}
    place = F.create_map(*[F.lit(x) for k, i in rank.items() for x in (k, i)])
    keyed = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.element_at(place, x["kind"]).alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"), x["match"].alias("match"))))
    return F.transform(keyed, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), x["match"].alias("match")))


def candidates(text: Column) -> Column:
    """Loose spans with their bit pattern: array<struct<start, end, kind, bits>>."""
    none = F.array().cast("array<struct<start:int,end:int,kind:string,match:string>>")
    found = F.concat(*[F.when(text.rlike(GATE[k]), located(text, LOOSE[k], k)).otherwise(none) for k in KINDS])
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), _bits(text, x).alias("bits")))


def _bits(text: Column, x: Column) -> Column:
    m, kind = x["match"], x["kind"]
    before = F.substr(text, F.greatest(x["start"] - 23, F.lit(1)), F.least(x["start"], F.lit(24)))
    around = F.concat(F.right(before, F.lit(1)), F.lit(" "), F.substr(text, x["end"] + 1, F.lit(1)))
    near = F.lit(False)
    for k in KINDS:
        near = near | ((kind == k) & before.rlike(CONTEXT[k]))
    flag = {k: kind == k for k in KINDS} | {
        "luhn": _luhn(m), "phone_digits": F.length(_digits(m)).between(9, 15), "octets": _octets(m), "context": near, "decoy": before.rlike(DECOY), "glued": around.rlike(r"[\p{L}\p{N}_]"),
        "issuer": _digits(m).rlike("^[3-6]"), "prefix": m.rlike(r"^(?:\(|00|0)"), "spelled": m.rlike(r"(?i)[(\[{]\x20?(?:at|dot|\.)\x20?[)\]}]"),
        "tld": m.rlike(r"(?i)(?<![a-z])(?:com|org|net|edu|gov|de|fr|es|io|info|co|uk|eu)$"), "grouped": m.rlike(r"^(?:\(?[0-9]{3}\)?[ ./-]{1,2}[0-9]{3}[ ./-][0-9]{4}|[0-9]{4}([ ._/-]{1,3})[0-9]{4}\1[0-9]{4}\1[0-9]{4})$"), "v6": m.rlike("^(?:[0-9A-Fa-f]{1,4}:){7}|^[0-9A-Fa-f]{3,4}:(?:[0-9A-Fa-f]{1,4}:)*:"),
        "hex": m.rlike("(?i)^[0-9a-f]{16,}$"), "mixed": kind.isin("secret", "id") & m.rlike("[0-9]") & m.rlike("[A-Za-z]") & (F.length(m) >= 12), "iban": F.when(kind == "id", _iban(m)).otherwise(F.lit(False)),
    }
    return sum((F.when(flag[b], F.lit(1 << i)).otherwise(F.lit(0)) for i, b in enumerate(BITS)), F.lit(0))


def examples(count: int = 4500, seed: int = 11) -> list[tuple[int, str, str, int, int]]:
    """(id, text, kind, start, end) of generated sentences; kind '' where nothing is personal."""
    rng = random.Random(seed)
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("aeinorstlmdu") for _ in range(rng.randint(3, 8)))

    def card(valid: bool) -> str:
        d = rng.choice("3456") + num(14)
        total = sum(int(c) if i % 2 else (2 * int(c) - 9 * (2 * int(c) > 9)) for i, c in enumerate(d))
        return d + str((10 - total % 10 + (0 if valid else rng.randint(1, 9))) % 10)

    def iban(valid: bool) -> str:
        country, account = rng.choice(["DE", "FR", "ES", "NL", "GB"]), num(18)
        check = 98 - int(account + "".join(str(ord(c) - 55) for c in country) + "00") % 97
        s = f"{country}{(check if valid else (check + rng.randint(1, 90)) % 97):02d}{account}"
        return " ".join(s[i : i + 4] for i in range(0, len(s), 4)) if rng.random() < 0.5 else s

    def made(kind: str, good: bool) -> str | tuple[str, str]:
        if kind == "email":
            at, dot = rng.choice([(" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", "."), ("(at)", "."), (" at ", " dot ")]) if good else rng.choice([(" at ", "."), (" at ", ". ")])
            return f"{word()}{at}{word()}{dot}{rng.choice(['com', 'org', 'net', 'de']) if good else word()}"
        if kind == "ip":
            if good and rng.random() < 0.4:
                if rng.random() < 0.5:
                    return ":".join(f"{rng.randint(0, 65535):x}" for _ in range(8))
                return f"{rng.randint(4096, 65535):x}:{rng.randint(0, 65535):x}::{rng.randint(1, 65535):x}"
            if not good and rng.random() < 0.2:
                return f"{rng.randint(1, 9)}::{rng.randint(1, 9)}"
            return rng.choice(["[.]", "(.)"] if good else ["[.]", " ."]).join(str(rng.randint(0, 255) if good else rng.randint(0, 999)) for _ in range(4))
        if kind == "card":
            c, s = card(good), rng.choice([".", "/", "_", "  ", " - "])
            return s.join(c[i : i + 4] for i in range(0, 16, 4))
        if kind == "secret":
            name = rng.choice(["token = ", "api_key: ", "password=", "secret = '", "PASSWORD: ", "access_key=", "token: \""])
            if good:
                value = rng.choice([f"{rng.getrandbits(160):040x}", f"{rng.getrandbits(128):032x}", "".join(rng.choice("abcdefghjkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789_-") for _ in range(rng.randint(12, 40))) + "7x"])
                return rng.choice([(name, value), (name, value), (name, value), ("", "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))), ("", f"{rng.getrandbits(160):040x}")])
            return rng.choice([(name, word() + word()), ("key: ", word() + "ing"), ("token = ", word() + "able"), ("password: ", "required"), ("key = ", word() + word())])
        if kind == "id":
            if good:
                return rng.choice([iban(True), iban(True), f"{num(3)}-{num(2)}-{num(4)}"])
            return rng.choice([iban(False), f"{rng.choice('ABKR')}{rng.choice('ABKR')}{num(2)} {num(4)} {num(4)}", "AB12CDEF3456"])
        if good:
            return rng.choice([f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"00{rng.randint(1, 9)}{num(1)} {num(3)} {num(6)}", f"0{num(3)}/{num(4)}{num(3)}", f"{num(3)}.{num(3)}.{num(4)}"])
        return rng.choice([f"{num(3)} {num(3)} {num(4)}", f"{num(3)}/{num(3)}/{num(4)}", f"0{num(2)} {num(3)} {num(4)}"])

    words = {"email": ["mail", "contact"], "ip": ["server", "host"], "card": ["card", "visa"], "phone": ["call", "phone", "tel"], "secret": ["use", "export"], "id": ["iban", "account", "ssn"]}
    decoys = ["order no", "serial", "part", "version", "ref", "invoice", "total"]
    out = []
    for i in range(count):
        kind, good = KINDS[i % len(KINDS)], rng.random() < 0.5
        if good:
            lead = rng.choice(words[kind]) if rng.random() < 0.7 or kind in ("phone",) else word()
        else:
            lead = rng.choice(decoys) if rng.random() < 0.6 else word()
            if kind == "id" and rng.random() < 0.5:  # a word before it makes no wrong number right
                lead = rng.choice(words[kind])
        span, start = made(kind, good), f"{word()} {word()} {lead} "
        if isinstance(span, tuple):  # what leads to a secret is no part of it
            start, span = start + span[0], span[1]
        out.append((i, f"{start}{span} {word()}", kind if good else "", len(start), len(start) + len(span)))
    return out


@dataclass(frozen=True)
class Model:
    shift: float
    trees: tuple[tuple[int, int, int, float, float, float, float], ...]  # root bit, bits left and right, values 00 01 10 11
    threshold: dict

    def score(self, bits: Column) -> Column:
        on = lambda b: bits.bitwiseAND(F.lit(1 << b)) != 0
        total = F.lit(self.shift)
        for root, low, high, v00, v01, v10, v11 in self.trees:
            total = total + F.when(on(root), F.when(on(high), v11).otherwise(v10)).otherwise(F.when(on(low), v01).otherwise(v00))
        return total

    def select(self, x: Column) -> Column:
        chosen = F.lit(False)
        for k in KINDS:
            chosen = chosen | ((x["kind"] == k) & (self.score(x["bits"]) >= self.threshold[k]))
        return chosen


def boost(rows: list[tuple[int, int, int]], rounds: int = 40, rate: float = 0.3) -> tuple[float, list]:
    """Second-order boosting of depth-two trees over (bits, negatives, positives)."""
    pos, neg = sum(r[2] for r in rows) + 1, sum(r[1] for r in rows) + 1
    shift, trees, total = math.log(pos / neg), [], {}
    total = {b: shift for b, _, _ in rows}

    def leaf(part):
        g = h = 0.0
        for b, n, p in part:
            q = 1 / (1 + math.exp(-max(-30.0, min(30.0, total[b]))))
            g += p - (n + p) * q
            h += (n + p) * q * (1 - q)
        return g * g / (h + 1.0), rate * g / (h + 1.0)

    for _ in range(rounds):
        best = None
        for root in range(len(BITS)):
            sides = [[r for r in rows if (r[0] >> root & 1) == s] for s in (0, 1)]
            made, gain = [], 0.0
            for side in sides:
                options = []
                for bit in range(len(BITS)):
                    halves = [leaf([r for r in side if (r[0] >> bit & 1) == s]) for s in (0, 1)]
                    options.append((halves[0][0] + halves[1][0], -bit, halves[0][1], halves[1][1]))
                top = max(options)
                gain += top[0]
                made.append(top)
            if best is None or gain > best[0] + 1e-12:
                best = (gain, (root, -made[0][1], -made[1][1], made[0][2], made[0][3], made[1][2], made[1][3]))
        trees.append(best[1])
        for b in total:
            total[b] += _tree(best[1], b)
    return shift, trees


def _tree(t: tuple, b: int) -> float:
    root, low, high, v00, v01, v10, v11 = t
    return (v11 if b >> high & 1 else v10) if b >> root & 1 else (v01 if b >> low & 1 else v00)


def train(spark: SparkSession, precision: float = 0.98) -> Model:
    return _train(spark, precision)


@lru_cache(maxsize=4)
def _train(spark: SparkSession, precision: float) -> Model:
    rows = spark.createDataFrame(examples(), "i int, text string, kind string, start int, end int")
    found = rows.select("i", F.col("kind").alias("gold"), F.col("start").alias("s"), F.col("end").alias("e"), F.explode(candidates(F.col("text"))).alias("c"))
    right = (F.col("c.kind") == F.col("gold")) & (F.col("c.start") < F.col("e")) & (F.col("c.end") > F.col("s"))
    counted = found.groupBy((F.floor(F.col("i") / len(KINDS)) % 3 == 0).alias("test"), F.col("c.kind").alias("kind"), F.col("c.bits").alias("bits")).agg(F.sum((~right).cast("long")).alias("n"), F.sum(right.cast("long")).alias("p"))
    got = sorted(map(tuple, counted.collect()))  # a row a bit pattern
    shift, trees = boost([(b, n, p) for test, _, b, n, p in got if not test])
    threshold = {}
    for kind in KINDS:  # the lowest score from which on the held-out examples have the wanted precision
        scored = sorted(((shift + sum(_tree(t, b) for t in trees), n, p) for test, k, b, n, p in got if test and k == kind), reverse=True)
        threshold[kind], n_all, p_all = math.inf, 0, 0
        for s, n, p in scored:
            n_all, p_all = n_all + n, p_all + p
            if p_all >= precision * (n_all + p_all) and s > 0:
                threshold[kind] = s - 1e-9
    return Model(shift, tuple(trees), threshold)


def detect(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """Adds ``base`` and ``found`` (all spans): array<struct<start, end, kind, match>>."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.withColumn("_pii_text", text).withColumn("base", base_spans(F.col("_pii_text"))).withColumn("_pii_near", candidates(F.col("_pii_text")))
    meets = lambda x, y: (x["start"] < y["end"]) & (y["start"] < x["end"])
    holds = lambda x, b: (x["start"] <= b["start"]) & (b["end"] <= x["end"]) & (x["end"] - x["start"] > b["end"] - b["start"])
    picked = F.filter("_pii_near", lambda x: model.select(x) & ~F.exists("base", lambda b: meets(x, b) & ~(x["kind"].isin("secret", "id") & holds(x, b))))
    d = d.withColumn("_pii_kept", F.transform(picked, lambda x: F.struct(model.score(x["bits"]).alias("score"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    better = lambda y, x: (y["score"] > x["score"]) | ((y["score"] == x["score"]) & ((y["start"] < x["start"]) | ((y["start"] == x["start"]) & (y["end"] > x["end"]))))
    kept = F.filter("_pii_kept", lambda x: ~F.exists("_pii_kept", lambda y: meets(x, y) & better(y, x)))
    extra = F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), F.substr(F.col("_pii_text"), x["start"] + 1, x["end"] - x["start"]).alias("match")))
    return d.withColumn("found", ordered(F.concat(F.col("base"), extra))).drop("_pii_text", "_pii_near", "_pii_kept")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """Texts with every span replaced by its kind in brackets (overlapping spans by the first one's)."""
    d = detect(docs, model, text_col=text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    walk = F.aggregate(
        "found",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda s, x: F.when(
            x["start"] >= s["at"],
            F.struct(x["end"].alias("at"), F.concat(s["out"], F.substr(text, s["at"] + 1, x["start"] - s["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]")).alias("out")),
        ).otherwise(F.struct(F.greatest(s["at"], x["end"]).alias("at"), s["out"].alias("out"))),
        lambda s: F.concat(s["out"], F.substr(text, s["at"] + 1, F.length(text))),
    )
    return d.withColumn(text_col, F.when(F.col(text_col).isNotNull(), walk)).drop("base", "found")
