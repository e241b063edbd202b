"""Personal data by weak supervision, in DataFrame operations alone.

Candidates come from patterns. Labelers vote on each: the strict rule of its pattern, a gazetteer, words of
its context in four languages, and its shape. Expectation-maximisation over the counts of vote patterns
estimates how reliable each labeler is for each kind. A logistic span classifier is then fitted to the
posteriors; besides the votes it sees the words around the span, its shape, its length and its neighbours.
Spans of the strict base rules always stay; the classifier adds candidates that those rules miss.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import materialize, read

KINDS = ("email", "ip", "card", "phone", "secret")
CONTEXT = 32  # characters before a candidate that the context labeler reads
AFTER = 16  # characters after it that the classifier reads
EM_ROUNDS = 60
BELIEF = 0.03
FIT_ROUNDS = 300
SAMPLE = 20_000  # different candidates (votes and features) that the classifier is fitted to, at most
BINS = 1024  # hashed features
THRESHOLD = 0.5

# Each finds what the plain rule finds, but never backs off: a run of characters is entered at its
# start only, so that the time is linear in the text.
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9]){15,}+"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Wider candidates: addresses written out, numbers of other forms, long random strings.
_WRITTEN = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[(\[{](?:at|arroba|chez)[)\]}]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[{](?:dot|punkt|punto|point)[)\]}]\x20?)[A-Za-z0-9-]++)++"
_IP6 = r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"
_DEFANGED = r"(?<![0-9.])[0-9]{1,3}(?:[\[({]\.[\])}][0-9]{1,3}){3}(?![0-9])"
_OTHER_CARD = r"(?<![0-9])(?:[0-9]{4}(?:[._/\xA0][0-9]{4}){3}|3[47][0-9]{2}[\x20-]?[0-9]{6}[\x20-]?[0-9]{5})(?![\x20-]?[0-9])"
_NATIONAL = r"(?<![0-9+.,/-])(?<![0-9]\x20)(?:\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}|\(?00?[1-9][0-9]{0,4}\)?(?:[\x20/.-][0-9]{2,8}){1,5})(?![0-9.,/-]*[0-9])"
_RANDOM = r"(?<![A-Za-z0-9+/_=.-])(?=[A-Za-z+/_-]{0,64}[0-9])(?=[0-9+/_-]{0,64}[A-Za-z])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9@]|\.[A-Za-z0-9])"

_OCTET = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9][0-9]?|(?<=0))"  # the last: zeros only
_IP_VALID = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
_IP6_VALID = r"^(?=.*[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=.*::)(?!.*::.*::)[0-9A-Fa-f:]+)$"

#: What each labeler looks for, by kind.
_GAZETTEER = {
    "email": r"(?i)(?:\.|[)\]}]\x20?)(?:[a-z]{2}|com|org|net|edu|gov|mil|int|info|biz|name|app|dev|shop|online|cloud)$",
    "ip": r"^(?!0*\.|0*(?:127|22[4-9]|2[3-5][0-9])\.|::1$)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|35|6011|65|62)",
    "phone": r"^(?:\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|\(?00?[1-9]|\(?[2-9][0-9]{2}\)?[\x20.-][2-9])",
    "secret": r"^(?:AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|sk[-_]|pk[-_]|xox[abpr]-|AIza|ya29|eyJ|-----BEGIN)",
}
#: Words of English, German, French and Spanish that announce or exclude a kind.
_FOR = {
    "email": r"(?iU)\b(?:e-?mail|mail|contact|write|reach|kontakt|schreib\w*|courriel|écri\w*|contacte\w*|correo|escrib\w*|contacto|adress\w*|dirección)\b",
    "ip": r"(?iU)\b(?:ip|ipv[46]|host|server|address|adresse|login|client|gateway|router|serveur|servidor|dirección|rechner|connexion|conexión)\b",
    "card": r"(?iU)\b(?:card|visa|mastercard|amex|credit|debit|(?:kredit)?karte\w*|carte|bancaire|tarjeta|crédito|payment|zahl\w*|paiement|pago)\b",
    "phone": r"(?iU)\b(?:phone|tel|telephone|telefon\w*|teléfono|téléphone|call\w*|mobile|fax|cell|whatsapp|anruf\w*|rufnummer|handy|appel\w*|portable|llam\w*|móvil)\b",
    "secret": r"(?iU)(?:\b|_)(?:token|secret\w*|passw\w*|pwd|key|apikey|credential\w*|bearer|kennwort|schlüssel|geheim\w*|mot de passe|clé|jeton|contraseña|clave|secreto)(?:\b|_)",
}
_AGAINST = {
    "": r"(?iU)\b(?:version|v|isbn|issn|doi|order|invoice|serial|build|ticket|sku|ref|id|bestellung|rechnung|commande|facture|pedido|factura)\b[^A-Za-z]*$",
    "secret": r"(?iU)\b(?:sha-?[0-9]*|md5|commit|digest|checksum|hash|integrity|prüfsumme|somme|suma|uuid|https?)\b",
}
_SHAPE = {
    "email": r"^[A-Za-z0-9](?:[A-Za-z0-9_%+-]|\.(?!\.)){0,63}\x20?[@(\[{]",
    "ip": r"^(?:0|[1-9][0-9]{0,2})(?:[\[({]?\.[\])}]?(?:0|[1-9][0-9]{0,2})){3}$|^[0-9A-Fa-f]{2,4}:[0-9A-Fa-f:]+$",
    "card": r"^(?:[0-9]{16,19}|[0-9]{15}|[0-9]{4}(?:([\x20._/\xA0-])[0-9]{4})(?:\1[0-9]{4}){2}(?:\1[0-9]{1,3})?|3[47][0-9]{2}([\x20-])[0-9]{6}\2[0-9]{5})$",
    "phone": r"^\+?[0-9]{0,3}\x20?(?:\([0-9]{1,5}\)|[0-9]{1,5})(?:[\x20/.-][0-9]{2,8}){1,5}$|^\+[0-9]{8,15}$",
    "secret": r"^(?:[0-9a-f]{32,}|[0-9A-F]{32,}|(?=.*[0-9].*[0-9].*[0-9])(?=.*[A-Za-z].*[A-Za-z].*[A-Za-z])(?!.*/.*/)[A-Za-z0-9+/_=-]{20,512})$",
}


_SPAN = "struct<start:int,end:int,value:string,before:string,after:string,gap:int>"


def matches(text: Column, pattern: str, block: int = 256) -> Column:
    """Spans of all matches: start and end in code points, what matched, the text just before and after
    it (up to the neighbouring match) and how far it is from the match before.

    The text between matches and the matches themselves are cut by the same search; starts are the
    running sums of their lengths, taken in blocks so that very many matches stay cheap.
    """
    pieces = F.split(text, pattern, -1)
    cut = F.zip_with(pieces, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda p, m: F.struct(p.alias("p"), m.alias("m")))
    cut = F.zip_with(
        F.filter(cut, lambda x: x["m"].isNotNull()),
        F.slice(pieces, F.lit(2), F.lit(1 << 30)),
        lambda x, after: F.struct(
            F.length(x["p"]).alias("gap"), F.length(x["m"]).alias("n"), x["m"].alias("value"), F.substring(x["p"], -CONTEXT, CONTEXT).alias("before"), F.substring(after, 1, AFTER).alias("after")
        ),
    )
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))

    def placed(x, start, end):
        return F.struct(start.alias("start"), end.alias("end"), *[x[c].alias(c) for c in ("value", "before", "after", "gap")])

    def step(acc, x):
        start = acc["at"] + x["gap"]
        return F.struct((start + x["n"]).alias("at"), F.concat(acc["out"], F.array(placed(x, start, start + x["n"]))).alias("out"))

    firsts = lambda a: F.filter(F.transform(a, lambda x, i: i), lambda i: i % block == 0)
    parts = F.transform(firsts(cut), lambda i: F.aggregate(F.slice(cut, i + 1, F.lit(block)), zero, step))
    whole = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{_SPAN}>>").alias("out"))

    def chain(acc, part):
        moved = F.transform(part["out"], lambda x: placed(x, x["start"] + acc["at"], x["end"] + acc["at"]))
        return F.struct((acc["at"] + part["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))

    return F.flatten(F.aggregate(parts, whole, chain)["out"])


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """True if the digits pass: every second from the right doubled, the sum of all digits 0 mod 10."""
    d = F.reverse(digits(value))

    def step(acc, x):
        n = F.ascii(x) - 48
        twice = F.when(n > 4, 2 * n - 9).otherwise(2 * n)
        return F.struct((1 - acc["odd"]).alias("odd"), (acc["sum"] + F.when(acc["odd"] == 1, twice).otherwise(n)).alias("sum"))

    zero = F.struct(F.lit(0).alias("odd"), F.lit(0).alias("sum"))
    return F.aggregate(F.filter(F.split(d, ""), lambda x: x != ""), zero, step)["sum"] % 10 == 0


def strict(kind: str, value: Column) -> Column:
    """The strict rule for what the base pattern of ``kind`` found."""
    n = F.length(digits(value))
    return {
        "email": F.lit(True),
        "ip": value.rlike(_IP_VALID),
        "card": F.when(n.between(16, 19), luhn(value)).otherwise(False),
        "phone": n.between(8, 15),
    }[kind]


def _wide_rule(kind: str, value: Column, before: Column) -> Column:
    """Vote of the strict rule on a wider candidate: 1, -1, or 0 where it can't tell."""
    n = F.length(digits(value))
    sign = lambda c: F.when(c, 1).otherwise(-1)
    return {
        "email": F.lit(0),
        "ip": F.when(F.contains(value, F.lit(":")), sign(value.rlike(_IP6_VALID))).otherwise(sign(F.regexp_replace(value, r"[^0-9.]", "").rlike(_IP_VALID))),
        "card": sign(luhn(value)),
        "phone": F.when(n.between(9, 15), 0).otherwise(-1),
        "secret": sign(value.rlike(_GAZETTEER["secret"]) | before.rlike(r"[:=]\x20{0,3}[\x22\x27]?$")),  # known, or assigned to a name
    }[kind]


def _hashed(name: str, kind: int, *values: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(name), F.lit(kind), *values), F.lit(BINS)).cast("int")


def _voted(kind: str, found: Column, wide: bool) -> Column:
    """Candidates as structs with the labelers' votes (1 for, -1 against, 0 none) and hashed features."""
    own = KINDS.index(kind)

    def one(x):
        value, before = x["value"], x["before"]
        bare = digits(value) if kind == "card" else value
        base = F.lit(False) if wide else strict(kind, value)
        sign = lambda c: F.when(c, 1).otherwise(-1)
        against = before.rlike(_AGAINST.get(kind, _AGAINST[""]))
        context = F.when(against, -1).when(before.rlike(_FOR[kind]), 1).otherwise(0)
        gazetteer = F.when(bare.rlike(_GAZETTEER[kind]), 1).otherwise(0 if kind == "secret" else -1)
        votes = [_wide_rule(kind, value, before) if wide else sign(base), gazetteer, context, sign(value.rlike(_SHAPE[kind]))]
        # runs of one class of characters become one mark, and long ones lose their length
        shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[0-9]+", "9"), "[a-z]+", "a"), "[A-Z]+", "A")
        last = lambda n: F.lower(F.regexp_extract(before, r"(?U)(\w+)\W+" + r"(?:\w+\W+)" * n + "$", 1))
        features = [
            *[_hashed(f"vote{i}", own, v) for i, v in enumerate(votes)],
            _hashed("wide", own, F.lit(wide)),
            _hashed("shape", own, F.substring(shape, 1, 24)),
            _hashed("length", own, F.floor(F.log2(F.length(value)) * 2)),
            _hashed("mark", own, F.substring(F.rtrim(before), -1, 1)),
            _hashed("word1", own, last(0)),
            _hashed("word2", own, last(1)),
            _hashed("next", own, F.lower(F.regexp_extract(x["after"], r"(?U)^\W*(\w+)\W", 1))),
            _hashed("near", own, F.least(x["gap"], F.lit(64)) < 4, x["gap"] == 0),
        ]
        return F.struct(F.lit(own).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), base.alias("base"), F.array(*votes).alias("votes"), F.array(*features).alias("features"))

    return F.transform(found, one)


_CANDIDATE = "array<struct<kind:int,start:int,end:int,base:boolean,votes:array<int>,features:array<int>>>"


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, ``found`` and ``wide``: all candidates of each whole text, those of the base patterns by kind
    and the wider ones."""
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast(_CANDIDATE)

    def look(kind, pattern, worth, wide=False):
        seen = worth & text.rlike(pattern)
        return F.when(seen, _voted(kind, matches(text, pattern), wide)).otherwise(none)

    has = lambda *marks: F.greatest(*[F.contains(text, F.lit(m)) for m in marks], F.lit(False))
    number = text.rlike("[0-9]")
    return docs.select(
        "doc_id",
        F.concat(
            look("email", _EMAIL, has("@")),
            look("ip", _IP, number),
            look("card", _CARD, number),
            look("phone", _PHONE, has("+")),
        ).alias("found"),
        F.concat(
            look("email", _WRITTEN, has("at)", "at]", "at}", "arroba", "chez"), True),
            look("ip", _IP6, has(":"), True),
            look("ip", _DEFANGED, has("[.]", "(.)", "{.}"), True),
            look("card", _OTHER_CARD, number, True),
            look("phone", _NATIONAL, number, True),
            look("secret", _RANDOM, number, True),
        ).alias("wide"),
    )


#: What a labeler is believed to do before anything is seen: shares of its votes (for, none, against) by class;
#: the strict rule, which comes first, seldom rejects what is genuine.
_STRICT = {0: {-1: 0.7, 0: 0.2, 1: 0.1}, 1: {-1: 0.01, 0: 0.29, 1: 0.7}}
_BELIEF = {0: {-1: 0.45, 0: 0.45, 1: 0.1}, 1: {-1: 0.1, 0: 0.3, 1: 0.6}}


def reliabilities(counts: dict[tuple, int], rounds: int = EM_ROUNDS, belief: float = BELIEF) -> dict[tuple, float]:
    """Posterior that a candidate is personal data, by (kind, votes), by expectation-maximisation.

    Each labeler has, for either class and each kind, its own chances of voting 1, 0 or -1; the votes
    are independent given the class. The start is the majority vote, the strict rule counting twice.
    ``belief`` is the weight, as a share of the candidates, of the belief that labelers are better than chance:
    without it a kind whose candidates are nearly all genuine would be split in two. ``counts`` is a bounded table: at
    most 3 to the number of labelers patterns a kind.
    """
    post: dict[tuple, float] = {}
    by_kind: dict[int, list[tuple]] = defaultdict(list)
    for key in counts:
        by_kind[key[0]].append(key)
        s = key[1][0] + sum(key[1])
        post[key] = min(0.95, max(0.05, 0.5 + 0.15 * s))
    for keys in by_kind.values():
        total = sum(counts[k] for k in keys)
        for _ in range(rounds):
            mass = sum(counts[k] * post[k] for k in keys)
            prior = (mass + 1) / (total + 2)
            chance = {}
            for i in range(len(keys[0][1])):
                for y in (0, 1):
                    weight = {v: 0.5 + belief * total * (_BELIEF if i else _STRICT)[y][v] for v in (-1, 0, 1)}
                    for k in keys:
                        weight[k[1][i]] += counts[k] * (post[k] if y else 1 - post[k])
                    norm = sum(weight[v] for v in (-1, 0, 1))
                    for v in (-1, 0, 1):
                        chance[i, y, v] = weight[v] / norm
            for k in keys:
                odds = math.log(prior / (1 - prior)) + sum(math.log(chance[i, 1, v] / chance[i, 0, v]) for i, v in enumerate(k[1]))
                post[k] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return post


def fit_spans(features: np.ndarray, post: np.ndarray, weight: np.ndarray, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """Weights of the logistic span classifier, one for each bin of hashed features, fitted to posteriors."""
    w, speed, total = np.zeros(BINS), np.zeros(BINS), weight.sum()
    flat = features.ravel()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(w[features].sum(axis=1), -30, 30)))
        slope = np.bincount(flat, np.repeat(weight * (p - post) / total, features.shape[1]), BINS) + 1e-5 * w
        speed += slope * slope
        w -= 0.3 * slope / (np.sqrt(speed) + 1e-9)
    return w


def train(table: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights of the classifier from the candidates of all documents.

    Equal candidates are counted before anything is gathered. Expectation-maximisation takes the counts of
    all vote patterns (at most 3^4 a kind). The classifier is fitted to ``sample`` different candidates at
    most, those of least hash, each weighing the root of its count.
    """
    own = table.select(F.explode(F.concat("found", "wide")).alias("x")).select("x.kind", "x.votes", "x.features")
    own = materialize(own.groupBy("kind", "votes", "features").agg(F.count("*").alias("n")), "patterns")
    counts = {(r["kind"], tuple(r["votes"])): r["n"] for r in own.groupBy("kind", "votes").agg(F.sum("n").alias("n")).collect()}
    if not counts:
        return np.zeros(BINS)
    post = reliabilities(counts)
    rows = own.orderBy(F.xxhash64("kind", "votes", "features"), "features", "kind", "votes").limit(sample).collect()
    return fit_spans(np.array([r["features"] for r in rows]), np.array([post[r["kind"], tuple(r["votes"])] for r in rows]), np.sqrt([r["n"] for r in rows]))


def _score(weights: np.ndarray, x: Column) -> Column:
    table = F.lit([round(float(w), 6) for w in weights])
    odds = F.aggregate(x["features"], F.lit(0.0), lambda s, f: s + F.element_at(table, f + 1))
    return 1 / (1 + F.exp(-odds))


def personal_data(docs: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """doc_id, base and spans (arrays of struct<kind, start, end>) of every row of ``docs``.

    ``base`` has what the strict rules find, ``spans`` these and what the classifier adds where no base
    span lies; what the strict rule of its pattern rejects (a checksum, a range) is added only if the context
    announces the kind. Both are by kind (email, ip, card, phone, and secret, which has no base rule), then start. Of
    added spans that overlap, one of lower start (then kind) stays. Positions are code points of the whole
    text, ends exclusive. Null and empty texts have none. Repeated rows each give a row, ids may be
    null, other columns are ignored. Without any candidate there is nothing to fit, and nothing is added.
    """
    table = materialize(candidates(docs), "spans")
    weights = train(table, sample)
    base = F.filter("found", lambda x: x["base"])
    free = lambda x: ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    some = F.size("found") + F.size("wide") > F.size(base)
    plain = lambda a: F.transform(a, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    vouched = lambda x: (F.element_at(x["votes"], 1) >= 0) | (F.element_at(x["votes"], 3) == 1)
    more = F.filter(F.concat("found", "wide"), lambda x: ~x["base"] & vouched(x) & free(x) & (_score(weights, x) >= threshold))
    more = F.array_sort(F.transform(more, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))
    nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int>>").alias("out"))
    apart = F.aggregate(more, nothing, lambda acc, x: F.when(x["start"] >= acc["at"], F.struct(x["end"].alias("at"), F.concat(acc["out"], F.array(x)).alias("out"))).otherwise(acc))["out"]
    both = F.when(some, F.concat(plain(base), plain(apart))).otherwise(plain(base))
    return table.select("doc_id", F.array_sort(plain(base)).alias("base"), F.array_sort(both).alias("spans"))


def _joined(spans) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the base spans, all spans, and how many there are, of every row of documents.

    Null and empty texts have no spans, and the digest of the empty text. Whole texts count, however long;
    repeated rows each give a row; an empty table gives none; other columns are ignored.
    """
    out = personal_data(read(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda i: F.size(F.filter("base", lambda x: x["kind"] == i)).cast("long")
    return out.select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])],
        F.sha2(_joined("base").cast("binary"), 256).alias("base_sha256"),
        _joined("spans").alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
    )
