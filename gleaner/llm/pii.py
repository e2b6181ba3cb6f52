"""Personal data: candidate spans, boosted trees, calibrated thresholds.

Base spans (e-mail, IP, card, phone numbers) follow fixed rules and always stay.
Beside them generators of high recall propose overlapping candidates: groups of
digits, long runs of digits, long mixed tokens and handles.  Gradient-boosted trees
score each from its format and its context, and those over their generator's
threshold are added unless they overlap a base span or a better candidate.

The trees are trained here, on the driver, on TRAIN_TEXTS seeded texts in five
languages made by a grammar in which every format also has look-alikes, and cases that
format and context leave open go either way.  A third of them calibrates each
generator's threshold, the lowest with a precision of PRECISION, and never under even
odds; another third measures what that gives (``calibration``).  Features of training
texts come from the same expressions as those of documents.  The trees are a constant
array that an expression folds over.

Native: DataFrame functions only.  Offsets are code points, ends are exclusive.
Positions come from a split and an extraction with one pattern: the texts between
the matches and the matches, in turn, make up the whole text.  Lengths are summed in
chunks and overlaps found by binary search, so a text of many matches takes little
more than linear time; all patterns walk a text in linear time and no text is cut.

Null and empty texts have no span.  Each row gives one row, repeated rows equal ones;
of equally scored overlapping candidates the first, then the first listed kind stays.
Other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import random
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import text_or_empty

KINDS = ("email", "ip", "card", "phone")
EXTRA = ("number", "digits", "secret", "handle")
TRAIN_TEXTS = 6_000
PRECISION = 0.95
#: Matches whose positions are summed up at a time.
CHUNK = 256

# The rules of the base kinds.  A run that can't match from its first character
# can't from a later one, so lookbehinds keep the search linear; \G lets a match
# follow another one at once.  Possessive loops don't backtrack or recurse.
_BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_HINT = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
_CANDIDATE = {
    "number": r"(?<![0-9A-Za-z(])\(?[0-9]{2,4}\)?(?:[\x20./-]{1,2}[0-9]{2,8}){1,5}(?![0-9A-Za-z])",
    "digits": r"(?<![0-9A-Za-z])[0-9]{7,19}(?![0-9A-Za-z])",
    "secret": r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{20,}+",
    "handle": r"(?<![A-Za-z0-9._%+-])@[A-Za-z0-9_]{3,30}+(?![A-Za-z0-9_.])",
}
_CANDIDATE_HINT = {"number": r"[0-9]{2}\)?[\x20./-]", "digits": r"[0-9]{7}", "secret": r"[A-Za-z0-9_+/=-]{20}", "handle": r"@"}


# The expressions are SQL text: a session makes one call for each column, where building
# them from Column objects takes some 50,000.


def _regex(pattern: str) -> str:
    return f"r'{pattern}'"


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _only_digits(c: str) -> str:
    return f"regexp_replace({c}, '[^0-9]', '')"


def _luhn(digits: str) -> str:
    """Of a name for a string of at least one digit."""
    n = f"cast(substr({digits}, length({digits}) - li, 1) as int)"
    return f"(aggregate(sequence(0, length({digits}) - 1), 0, (lt, li) -> lt + if(li % 2 = 1, if({n} > 4, {n} * 2 - 9, {n} * 2), {n})) % 10 = 0)"


def _valid(kind: str, m: str) -> str:
    if kind == "ip":
        part = "trim(LEADING '0' FROM vp)"
        return f"forall(split({m}, r'\\.'), vp -> length({part}) <= 3 and coalesce(try_cast(substr({part}, 1, 3) as int), 0) <= 255)"
    if kind == "card":
        return _let(_only_digits(m), "vd", f"length(vd) between 12 and 19 and {_luhn('vd')}")
    if kind == "phone":
        return f"length({_only_digits(m)}) between 9 and 15"
    return "true"


def _mixed(kind: str, m: str) -> str:
    return _let(_only_digits(m), "vd", f"length(vd) >= 4 and length(vd) < length({m})") if kind == "secret" else "true"


_SPANS = "array<struct<start:int,end:int,value:string,before:string,after:string>>"
_NO_TEXT = "cast(array() as array<string>)"


def _starts(between: str, found: str) -> str:
    """Where each match starts.  Growing an array copies it, so sums run in chunks."""
    lengths = f"transform({found}, (sm, si) -> named_struct('gap', length(element_at({between}, si + 1)), 'own', length(sm)))"
    chunk = f"slice(sl, sc * {CHUNK} + 1, {CHUNK})"
    grow = lambda at, step: f"named_struct('at', sa.at + {step}, 'out', concat(sa.out, array({at})))"
    empty = lambda at: f"named_struct('at', {at}, 'out', cast(array() as array<int>))"
    sums = f"transform(sequence(0, cast(floor((size({found}) - 1) / {CHUNK}) as int)), sc -> aggregate({chunk}, 0, (sa, sx) -> sa + sx.gap + sx.own))"
    firsts = f"aggregate({sums}, {empty('0')}, (sa, sx) -> {grow('sa.at', 'sx')}, sa -> sa.out)"
    inner = f"aggregate({chunk}, {empty('sf')}, (sa, sx) -> {grow('sa.at + sx.gap', 'sx.gap + sx.own')}, sa -> sa.out)"
    return _let(lengths, "sl", f"flatten(transform({firsts}, (sf, sc) -> {inner}))")


def _with_matches(rows: DataFrame, patterns: dict[str, str], hints: dict[str, str], valid) -> DataFrame:
    """``rows`` with an array of the valid spans of each pattern, named by it, in order:
    start, end, value and the characters before and after."""
    some = {k: f"size(__f{k}) > 0" for k in patterns}
    rows = rows.withColumns({f"__f{k}": F.expr(f"if(text rlike {_regex(hints[k])}, regexp_extract_all(text, {_regex(p)}, 0), {_NO_TEXT})") for k, p in patterns.items()})
    rows = rows.withColumns({f"__b{k}": F.expr(f"if({some[k]}, split(text, {_regex(p)}, -1), {_NO_TEXT})") for k, p in patterns.items()})
    made = {}
    for k in patterns:
        n, f, b = f"size(__f{k})", f"__f{k}", f"__b{k}"
        parts = {"s": _starts(b, f), "gap": f"slice({b}, 1, {n})", "rest": f"slice({b}, 2, {n})", "last": f"concat(array(''), slice({f}, 1, {n} - 1))", "next": f"concat(slice({f}, 2, {n}), array(''))"}
        made |= {f"__{x}{k}": F.expr(f"if({some[k]}, {c}, null)") for x, c in parts.items()}
    rows = rows.withColumns(made)

    def spans(k: str) -> Column:
        at, m = f"x.__s{k}", f"x.__f{k}"
        one = f"named_struct('start', {at}, 'end', {at} + length({m}), 'value', {m}, 'before', right(concat(x.__last{k}, x.__gap{k}), 24), 'after', left(concat(x.__rest{k}, x.__next{k}), 6))"
        zipped = ", ".join(f"__{x}{k}" for x in ("f", "s", "gap", "rest", "last", "next"))
        return F.expr(f"if({some[k]}, transform(filter(arrays_zip({zipped}), x -> {valid(k, m)}), x -> {one}), cast(array() as {_SPANS}))").alias(k)

    return rows.select(*(c for c in rows.columns if not c.startswith("__")), *map(spans, patterns))


def _before(spans: str, field: str, value: str) -> str:
    """How many of the sorted ``spans`` have a ``field`` less than ``value``."""
    mid = "cast((ba.low + ba.high) div 2 as int)"
    less = f"(ba.low < ba.high and coalesce(get({spans}, {mid}).`{field}`, 0) < {value})"
    halve = f"named_struct('low', if({less}, {mid} + 1, ba.low), 'high', if({less} or ba.low >= ba.high, ba.high, {mid}))"
    return f"aggregate(sequence(0, cast(floor(log2(greatest(size({spans}), 1))) as int) + 1), named_struct('low', 0, 'high', size({spans})), (ba, bs) -> {halve}, ba -> ba.low)"


#: Features of a candidate: what it looks like and what stands around it.
FEATURES = ("digits", "letters", "upper", "separators", "groups", "luhn", "money", "phone_word", "secret_word", "id_word", "handle_word", "thing_word", "code", "hex", "quoted", "ssn", "local", "date", "year", "mark", "generator")
# Context words of the features, in five languages.
_CONTEXT = {
    "phone_word": "tel|phone|call|fax|mobile|cell|telefon|handy|rufnummer|t[ée]l[ée]phone|portable|appeler|tel[ée]fono|m[óo]vil|llamar|telefono|cellulare|chiamare",
    "secret_word": "token|secret|key|password|passwd|pwd|bearer|apikey|auth|passwort|schl[üu]ssel|mot de passe|cl[ée]|contrase[ñn]a|clave|chiave",
    "id_word": "ssn|passport|account|acct|iban|licen[cs]e no|tax id|patient|konto|ausweis|steuernummer|compte|passeport|cuenta|pasaporte|dni|conto|passaporto",
    "handle_word": "twitter|follow|contact|dm|insta|instagram|user|telegram|by|folgt|kontakt|suivez|contactez|sigue|contacto|segui|contatto",
    "thing_word": "order|item|part|isbn|build|version|invoice|model|serial|commit|sha|md5|checksum|digest|uuid|score|pages?|years?|rows|bestellung|artikel|rechnung|seiten?|commande|facture|pedido|factura|ordine|fattura|no",
}


def _features(generator: int, x: str) -> str:
    """Of ``x``, a struct of value, before and after."""
    value, before, after = (f"{x}.{c}" for c in ("value", "before", "after"))
    number = lambda c: f"cast({c} as double)"
    like = lambda c, p: f"{c} rlike {_regex(p)}"
    others = lambda p: number(f"length(regexp_replace({value}, {_regex(p)}, ''))")
    near = lambda kind: number(like("fc", rf"(?<![a-zà-ÿ])(?:{_CONTEXT[kind]})[a-z]{{0,3}}[^a-z0-9]{{0,6}}\z"))
    parts = {
        "digits": number("length(fd)"),
        "letters": others("[^A-Za-z]"),
        "upper": others("[^A-Z]"),
        "separators": others("[A-Za-z0-9]"),
        "groups": number(f"size(split({value}, '[^A-Za-z0-9]+'))"),
        "luhn": f"if(length(fd) between 12 and 19, {number(_luhn('fd'))}, 0.0D)",
        "money": number(f"({like(before, r'[$€£#][\x20]?\z')} or {like(after, r'\A[\x20]?(?:[€%]|USD|EUR|kg|km|px|ms)')})"),
        **{kind: near(kind) for kind in _CONTEXT},
        "code": number(f"({like(after, r'\A\s?[({<]|\A\n')} or {like(before, r'(?:\n|\A)\s*\z')})"),
        "hex": number(like(value, r"\A[0-9a-f]{20,}\z")),
        "quoted": number(like(before, r"[=:][\x20]?[\x22\x27]?\z")),
        "ssn": number(like(value, r"\A[0-9]{3}-[0-9]{2}-[0-9]{4}\z")),
        "local": number(like(value, r"\A\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}\z")),
        "date": number(like(value, r"\A(?:(?:19|20)[0-9]{2}[./-][0-9]{2}[./-][0-9]{2}|[0-9]{2}[./-][0-9]{2}[./-](?:19|20)[0-9]{2})")),
        "year": number(like(value, r"(?<![0-9])(?:19|20)[0-9]{2}(?![0-9])")),
        "mark": number(like(value, "[0-9_]")),
        "generator": f"{float(generator)}D",
    }
    return _let(_only_digits(value), "fd", _let(f"lower({before})", "fc", f"array({', '.join(parts[f] for f in FEATURES)})"))


def _candidates(rows: DataFrame) -> DataFrame:
    """``rows`` with the candidates of each generator: (start, end, g, features)."""
    rows = _with_matches(rows, _CANDIDATE, _CANDIDATE_HINT, _mixed)
    return rows.withColumns({k: F.expr(f"transform({k}, x -> named_struct('start', x.`start`, 'end', x.`end`, 'g', {g}, 'features', {_features(g, 'x')}))") for g, k in enumerate(EXTRA)})


# -- training ---------------------------------------------------------------


def training_texts(n: int = TRAIN_TEXTS, seed: int = 5) -> list[tuple[str, int]]:
    """Texts with one case each, and whether it is personal or secret."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    of = lambda k, chars: "".join(r.choice(chars) for _ in range(k))
    alnum = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    word = lambda: of(r.randint(2, 9), "etaoinshrdlu")
    name = lambda: r.choice([word() + "_" + word(), word() + d(2), word() + word(), word() + "_" + d(3)])
    local = lambda: r.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"0{d(2)} {d(4)} {d(4)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"{d(3)} {d(3)} {d(3)}"])
    date = lambda: r.choice([f"{r.choice(['19', '20'])}{d(2)}-{d(2)}-{d(2)}", f"{d(2)}/{d(2)}/20{d(2)}", f"{d(2)}.{d(2)}.19{d(2)}"])
    hexed, mixed = lambda: of(r.choice([24, 32, 40, 64]), "0123456789abcdef"), lambda: of(r.randint(20, 48), alnum)
    phone = ["call ", "tel: ", "phone ", "mobile: ", "fax ", "Telefon: ", "Handy ", "téléphone : ", "portable ", "teléfono: ", "móvil ", "telefono: ", "cellulare "]
    person = ["ssn ", "SSN: ", "account ", "acct: ", "passport ", "patient ", "Konto ", "Ausweis ", "compte ", "passeport : ", "cuenta ", "pasaporte ", "conto "]
    secret = ["token = \"", "secret: ", "api key=", "password: ", "key = '", "Authorization: Bearer ", "Passwort: ", "mot de passe : ", "contraseña: ", "chiave "]
    social = ["twitter ", "follow ", "contact ", "DM ", "insta: ", "user ", "Kontakt ", "suivez ", "contactez ", "sigue ", "segui "]
    thing = ["order ", "item ", "part no ", "isbn ", "build ", "invoice ", "serial ", "Bestellung ", "Artikel ", "commande ", "facture ", "pedido ", "ordine ", "score "]
    proof = ["commit ", "sha ", "md5: ", "checksum ", "digest ", "uuid ", "version ", "model "]
    cases = {
        "number": ([lambda: r.choice(phone) + local(), lambda: r.choice(person) + f"{d(3)}-{d(2)}-{d(4)}"], [lambda: r.choice(thing) + local(), lambda: r.choice(["", "on ", "am ", "le "]) + date(), lambda: r.choice(["pages ", "years ", ""]) + r.choice([f"{d(4)}-{d(4)}", f"{d(2)}-{d(2)}", f"{d(2)} {d(2)} {d(2)}", f"19{d(2)}-20{d(2)}"]), lambda: r.choice(thing) + f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", lambda: r.choice(["", "v", "version "]) + f"{d(2)}.{d(2)}.{d(2)}"], local),
        "digits": ([lambda: r.choice(person) + d(r.randint(8, 12)), lambda: r.choice(phone) + d(r.randint(9, 11))], [lambda: r.choice(thing) + d(r.randint(7, 19)), lambda: r.choice(["$ ", "€", "#"]) + d(r.randint(7, 9)), lambda: "ts 1" + d(9)], lambda: d(10)),
        "secret": ([lambda: r.choice(secret) + r.choice([hexed, mixed])(), lambda: r.choice(["AKIA" + of(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), "ghp_" + of(36, alnum), "sk-" + of(40, alnum)])], [lambda: r.choice(proof) + hexed(), lambda: r.choice(proof) + f"{hexed()[:8]}-{hexed()[:4]}-{hexed()[:4]}-{hexed()[:12]}", lambda: r.choice(["", "class ", "see "]) + "-".join(word() + d(r.randint(0, 3)) for _ in range(5)), lambda: "/".join(word() for _ in range(4)) + "/2024/" + d(4), lambda: "=" * r.randint(20, 30) + d(4)], hexed),
        "handle": ([lambda: r.choice(social) + "@" + name()], [lambda: r.choice(["\n", "  ", "use "]) + "@" + r.choice(["param x", "Override\n", "media (", "import ", "here ", "return ", "deprecated\n", "property\n", "2x ", "test(", "see "]), lambda: r.choice(["", "at ", "für "]) + "@" + d(3)], lambda: word() + " @" + name()),
    }
    out = []
    for i in range(n):
        good, bad, open_ = cases[EXTRA[i % 4]]
        label, how = (1, r.choice(good)) if r.random() < 0.45 else (0, r.choice(bad))
        if r.random() < 0.1:  # neither format nor context tells
            label, how = int(r.random() < 0.4), open_
        out.append((" ".join(word() for _ in range(3)) + " " + how() + r.choice(["", "\"", ",", "."]) + " " + word(), label))
    return out


def _fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 40, rate: float = 0.3) -> list[tuple]:
    """Boosted trees of depth two on the logistic loss: (feature, threshold, left,
    right) with leaves as numbers."""

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
        leaf = float(rate * g[rows].sum() / (h[rows].sum() + 1.0))
        if depth == 0 or len(rows) < 40:
            return leaf
        whole, best = g[rows].sum() ** 2 / (h[rows].sum() + 1.0), (1e-6, None)
        for j in range(x.shape[1]):
            values = np.unique(x[rows, j])
            for t in (values[:-1] + values[1:])[:: max(1, len(values) // 24)] / 2:
                left = x[rows, j] <= t
                a, b = rows[left], rows[~left]
                gain = g[a].sum() ** 2 / (h[a].sum() + 1.0) + g[b].sum() ** 2 / (h[b].sum() + 1.0) - whole
                if gain > best[0]:
                    best = (gain, (j, float(t), a, b))
        if best[1] is None:
            return leaf
        j, t, a, b = best[1]
        return j, t, grow(a, g, h, depth - 1), grow(b, g, h, depth - 1)

    trees, odds = [], np.zeros(len(y))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-odds))
        tree = grow(np.arange(len(y)), y - p, p * (1 - p), 2)
        trees.append(tree)
        odds += _evaluate(tree, x)
    return trees


def _evaluate(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    j, t, a, b = tree
    return np.where(x[:, j] <= t, _evaluate(a, x), _evaluate(b, x))


def _as_row(tree) -> tuple:
    """A tree of depth two as (feature, threshold) of the root, the left and the right
    split, and the four leaves; a leaf further up is a split with equal leaves."""
    split = lambda t: t if isinstance(t, tuple) else (0, 0.0, t, t)
    (j, t, a, b), out = split(tree), []
    for side in (a, b):
        k, u, left, right = split(side)
        out.append((k, u, left, right))
    return (j, t, out[0][0], out[0][1], out[1][0], out[1][1], out[0][2], out[0][3], out[1][2], out[1][3])


def _forest(trees: list[tuple]) -> str:
    """The trees as an array of structs: data, so the plan doesn't grow with them."""
    names = ("j", "t", "k", "u", "l", "v", "a", "b", "c", "d")
    rows = (", ".join(f"'{n}', {v!r}{'D' if isinstance(v, float) else ''}" for n, v in zip(names, _as_row(t), strict=True)) for t in trees)
    return f"array({', '.join(f'named_struct({r})' for r in rows)})"


def _log_odds(forest: str, features: str) -> str:
    at = lambda i, least: f"get({features}, ot.{i}) <= ot.{least}"
    leaf = f"if({at('j', 't')}, if({at('k', 'u')}, ot.a, ot.b), if({at('l', 'v')}, ot.c, ot.d))"
    return f"aggregate({forest}, 0.0D, (os, ot) -> os + {leaf})"


def _threshold(odds: np.ndarray, truth: np.ndarray) -> float:
    """The lowest log-odds of even odds or more over which precision holds."""
    order = np.argsort(-odds, kind="stable")
    precision = np.cumsum(truth[order]) / (np.arange(len(order)) + 1)
    # Only where the score changes can a threshold lie.
    last = np.append(odds[order][1:] < odds[order][:-1], True) if len(order) else np.zeros(0, bool)
    good = np.flatnonzero((precision >= PRECISION) & last)
    return max(0.0, float(odds[order][good[-1]])) if len(good) else float("inf")


def train(spark: SparkSession) -> tuple[list[tuple], list[float], dict[str, tuple[float, float, int]]]:
    """Trees, for each generator the log-odds over which precision holds, and on texts
    that neither has seen its precision, recall and number of candidates."""
    texts = training_texts()
    rows = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps([{"text": t, "label": n, "part": i // 4 % 3} for i, (t, n) in enumerate(texts)])), "array<struct<text:string,label:int,part:int>>")).alias("r")).select("r.text", "r.label", "r.part")
    found = _candidates(rows).select("text", "label", "part", F.explode(F.concat(*EXTRA)).alias("c")).select("text", "label", "part", "c.g", "c.features").collect()
    found.sort(key=lambda r: (r["text"], r["g"], r["features"]))
    x, y, g, part = (np.array([r[c] for r in found], float) for c in ("features", "label", "g", "part"))
    trees = _fit_trees(x[part == 0], y[part == 0])
    odds = sum(_evaluate(t, x) for t in trees)
    thresholds, report = [], {}
    for k, kind in enumerate(EXTRA):
        own = (g == k) & (part == 1)
        thresholds.append(_threshold(odds[own], y[own]))
        own = (g == k) & (part == 2)
        over = odds[own] >= thresholds[-1]
        report[kind] = (float(y[own][over].mean()) if over.any() else 0.0, float(over[y[own] == 1].mean()), int(own.sum()))
    return trees, thresholds, report


def calibration(spark: SparkSession) -> dict[str, tuple[float, float, int]]:
    """For each generator precision, recall and candidates on held-out texts."""
    return _model(spark.sparkContext.applicationId)[2]


@lru_cache(maxsize=4)
def _model(application: str):
    return train(SparkSession.getActiveSession())


# -- the operator ------------------------------------------------------------


def find(docs: DataFrame) -> DataFrame:
    """doc_id, text, base and extra: arrays of (start, rank, end, kind) by start,
    then kind as listed in KINDS and EXTRA."""
    trees, thresholds, _ = _model(docs.sparkSession.sparkContext.applicationId)
    forest = _forest(trees)
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    rows = _candidates(_with_matches(rows, _BASE, _HINT, _valid))

    def over(k: str, least: float) -> Column:
        scored = f"transform({k}, c -> named_struct('start', c.`start`, 'end', c.`end`, 'g', c.g, 'odds', {_log_odds(forest, 'c.features')}))"
        return F.expr(f"if(size({k}) > 0, filter({scored}, c -> c.odds >= double('{least}')), cast(array() as array<struct<start:int,end:int,g:int,odds:double>>))")

    def free(k: str) -> Column:
        """Those that no base span overlaps: the last that starts before their end ends
        before them.  Spans of one kind are in order and don't overlap."""
        clear = " and ".join(f"(size({b}) = 0 or coalesce(get({b}, {_before(b, 'start', 'c.`end`')} - 1).`end`, 0) <= c.`start`)" for b in KINDS)
        return F.expr(f"if(size({k}) > 0, filter({k}, c -> {clear}), {k})")

    def beaten(k: str) -> str:
        """Whether a better candidate of k overlaps c."""
        better = "(o.odds > c.odds or (o.odds = c.odds and (o.`start` < c.`start` or (o.`start` = c.`start` and o.g < c.g))))"
        run = f"named_struct('low', {_before(k, 'end', 'c.`start` + 1')}, 'high', {_before(k, 'start', 'c.`end`')})"
        return f"(size({k}) > 0 and exists(array({run}), w -> w.high > w.low and exists(slice({k}, w.low + 1, w.high - w.low), o -> {better})))"

    def kept(k: str) -> str:
        best = f"filter({k}, c -> not ({' or '.join(beaten(o) for o in EXTRA if o != k)}))"
        return f"if(size({k}) > 0, {_spans(best, len(KINDS) + EXTRA.index(k), k)}, cast(array() as {_NAMED}))"

    rows = rows.withColumns({k: over(k, least) for k, least in zip(EXTRA, thresholds, strict=True)})
    rows = rows.withColumns({k: free(k) for k in EXTRA})
    base = f"array_sort(concat({', '.join(_spans(k, i, k) for i, k in enumerate(KINDS))}))"
    return rows.select("doc_id", "text", F.expr(base).alias("base"), F.expr(f"array_sort(concat({', '.join(map(kept, EXTRA))}))").alias("extra"))


_NAMED = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _spans(found: str, rank: int, kind: str) -> str:
    return f"transform({found}, x -> named_struct('start', x.`start`, 'rank', {rank}, 'end', x.`end`, 'kind', '{kind}'))"


def spelled(spans: str | Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(found: DataFrame, mask: str = "[{}]") -> DataFrame:
    """doc_id and the text with every span, or run of overlapping spans, replaced
    by the mask with the first span's kind."""
    spans = F.array_sort(F.concat("base", "extra"))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    left, right = mask.split("{}")

    def step(acc: Column, s: Column) -> Column:
        clear = s["start"] >= acc["at"]
        new = F.concat(acc["out"], F.substr("text", acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))), F.lit(left), s["kind"], F.lit(right))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(clear, new).otherwise(acc["out"]).alias("out"))

    rows = found.withColumn("__spans", spans).withColumn("__acc", F.aggregate("__spans", start, step))
    return rows.select("doc_id", F.concat(F.col("__acc.out"), F.substr("text", F.col("__acc.at") + 1, F.length("text"))).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    extra = F.size("extra").cast("long")
    both = spelled(F.array_sort(F.concat("base", "extra")))
    return found.select("doc_id", *(count(k) for k in KINDS), F.sha2(spelled("base"), 256).alias("base_sha256"), both.alias("spans"), extra.alias("n_extra"), (F.size("base") + extra).cast("long").alias("n_spans"))
