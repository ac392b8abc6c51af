"""License scan: ordered signature rules behind keyword gates, overlaps resolved by priority.

Everything is a column expression on the row of a text: nothing is shuffled, and no Python
runs on the executors.  A text is first tested for a few roots; only texts that hold one are
lower-cased and given to the rules, and a rule's pattern only sees texts that hold its gate.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensio.llm.license_rules import Rule, all_rules, spaced

#: Every gate holds one of these; a text with none of them has no match (tested).
ROOTS = [
    "licen", "lizen", "gpl", "gfdl", "public", "copyright", "warrant", "permission", "reserved", "vorbehalten", " droits ", "derechos", "reproduced", "distribut", "apache", " bsd ",
    "spdx", " cc ", " cc0 ", "creative", "commons", "unencumbered", "proprietary", " under mit ", " mit no ", " mpl ", " cddl ", " eupl ", " ms pl ", " ofl ", " odbl ", "wtfpl",
    "beerware", " a beer ", "polyform", "cecill", "openrail", " ouverte ", "gemeinfrei", " domaine ", " dominio ", "openssl", " eric young ", " perl itself ", " promote ",
    "advertising", "autoconf", " linking this ", "exception", "dedicated", " plainly marked ", " provided as is ", " in the software ", " with the software ", "commercial",
    " contained in this ", "unicode", " the fuck ", " shall be used for ", " bajo ", "copying", " without restriction ", " written agreement ", " open data ",
]

#: The phrases whose places are counted: their rules' labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Strength of the evidence by priority: notice or tag, versioned name, name, hint.
WEIGHTS = {1: 1.0, 2: 0.9, 3: 0.7, 4: 0.2}

#: Characters between words, before and after A-Z are lower-cased.
_GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

FOUND = "array<struct<label:string,rule:int,priority:int,first_word:bigint,end_word:bigint,kept:boolean>>"


def _words(s: Column) -> Column:
    """Words of a spaced text: half its blanks."""
    return ((F.octet_length(s) - F.octet_length(F.replace(s, F.lit(" "), F.lit("")))) / 2).cast("long")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body uses it.

    A plain column would be copied into every place, inside loops over arrays too.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Steps of a running sum: the powers of two below the number of values.
_POWERS = [1 << k for k in range(31)]


def _running(values: Column, step) -> Column:
    """``step`` over all values up to each one (a sum, a maximum), in log2(n) passes."""
    doublings = F.filter(F.array(*[F.lit(p) for p in _POWERS]), lambda p: p < F.size(values))
    return F.aggregate(doublings, values, lambda acc, p: F.transform(acc, lambda x, i: F.when(i >= p, step(x, F.get(acc, i - p))).otherwise(x)))


def _rule_table(rules: list[Rule]) -> Column:
    """The rules as one constant: groups by the longest word of the gate, each with its rules."""
    groups: dict[str, list[Rule]] = {}
    for rule in rules:
        groups.setdefault(max(rule.gate.split(), key=len), []).append(rule)
    table = [{"word": f" {word} ", "rules": [{"rule": r.number, "label": r.label, "priority": r.priority, "gate": spaced(r.gate), "pattern": spaced(r.pattern)} for r in members]} for word, members in groups.items()]
    return F.from_json(F.lit(json.dumps(table)), "array<struct<word:string,rules:array<struct<rule:int,label:string,priority:int,gate:string,pattern:string>>>>")


def _places(text: Column, rule: Column) -> Column:
    """Where the rule's pattern stands, as an array of matches in the order of the text."""

    def located(hits: Column) -> Column:
        before = F.slice(F.split(text, rule["pattern"]), 1, F.size(hits))
        lengths = F.zip_with(before, hits, lambda b, hit: F.struct((_words(b) + _words(hit)).alias("end"), _words(hit).alias("size")))
        ends = _let(lengths, lambda v: _running(v, lambda x, y: F.struct((x["end"] + y["end"]).alias("end"), x["size"].alias("size"))))
        return F.transform(
            ends,
            lambda x: F.struct((x["end"] - x["size"]).alias("first_word"), (-x["end"]).alias("before"), rule["priority"].alias("priority"), rule["rule"].alias("rule"), rule["label"].alias("label")),
        )

    return _let(F.call_function("regexp_extract_all", text, rule["pattern"], F.lit(0)), lambda hits: F.when(F.size(hits) > 0, located(hits)))


def _matches(text: Column, rules: list[Rule]) -> Column:
    """All matches of the rules whose gate the text holds, by place, the longer first."""
    chosen = F.flatten(F.transform(F.filter(_rule_table(rules), lambda g: F.contains(text, g["word"])), lambda g: F.filter(g["rules"], lambda r: F.contains(text, r["gate"]))))
    return F.sort_array(F.flatten(F.filter(F.transform(chosen, lambda r: _places(text, r)), lambda m: m.isNotNull())))


def _judged(matches: Column) -> Column:
    """``FOUND`` of sorted matches: one goes if an earlier one of its priority or above reaches as far."""
    zero = F.lit(0).cast("long")
    # The furthest end up to each match, for each priority and the ones above it.
    reach = F.transform(matches, lambda m: F.struct(*[F.when(m["priority"] <= p, -m["before"]).otherwise(zero).alias(f"p{p}") for p in WEIGHTS]))
    reach = _let(reach, lambda v: _running(v, lambda x, y: F.struct(*[F.greatest(x[f"p{p}"], y[f"p{p}"]).alias(f"p{p}") for p in WEIGHTS])))

    def judge(reached: Column):
        def one(m: Column, i: Column) -> Column:
            best = zero
            for p in WEIGHTS:
                best = F.when(m["priority"] == p, F.get(reached, i - 1)[f"p{p}"]).otherwise(best)
            kept = (i == 0) | (best < -m["before"])
            return F.struct(m["label"].alias("label"), m["rule"].alias("rule"), m["priority"].alias("priority"), m["first_word"].alias("first_word"), (-m["before"]).alias("end_word"), kept.alias("kept"))

        return F.transform(matches, one)

    return _let(reach, judge)


def with_licenses(df: DataFrame, text: str = "text", keep: list[str] | None = None, rules: list[Rule] | None = None) -> DataFrame:
    """``keep`` columns (default: all but ``text``), ``n_words`` and ``licenses``.

    ``licenses`` is an array of ``FOUND``, in the order of the text: every match of a rule with
    its label, its place in words (``end_word`` exclusive) and whether it is ``kept``.  A match
    goes if its interval lies in that of another match of a smaller or equal priority; of equal
    intervals the smaller priority stays, then the earlier rule.  Matches of one rule do not
    overlap, as in any search from left to right.

    NULL and empty texts have no words and an empty array.  A text is worked on whole, in one
    row; time grows with its length (times the logarithm of its matches).  Repeated rows are
    judged each for itself.  Columns named ``n_words`` or ``licenses`` are left out.
    """
    rules = all_rules() if rules is None else rules
    names = ("n_words", "licenses")
    keep = [c for c in (df.columns if keep is None else keep) if c not in names and (keep is not None or c != text)]
    carried = [F.col(f"c{i}") for i in range(len(keep))]
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    out = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.trim(F.regexp_replace(t, _GAPS, "  ")).alias("__t"))
    out = out.select(*carried, F.when(F.col("__t") == "", "").otherwise(F.concat(F.lit(" "), F.col("__t"), F.lit(" "))).alias("__t"))
    # Unicode lower-casing only ever widens this test; the words themselves get A-Z lower-cased.
    low = F.lower("__t")
    out = out.select(*carried, _words(F.col("__t")).alias("n_words"), "__t", low.alias("__low"))
    test = F.lit(False)
    for root in ROOTS:
        test = test | F.col("__low").contains(spaced_root(root))
    out = out.select(*carried, "n_words", F.when(test, F.translate("__t", _UPPER, _LOWER)).otherwise("").alias("__t"))
    found = _let(F.col("__t"), lambda t: F.when(t != "", _let(_matches(t, rules), _judged)))
    found = F.coalesce(found, F.array().cast(FOUND)).cast(FOUND)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "n_words", found.alias("licenses"))


def spaced_root(root: str) -> str:
    """A root as it stands in a spaced text: a blank between words is two there."""
    inner = root.strip().replace(" ", "  ")
    return (" " if root.startswith(" ") else "") + inner + (" " if root.endswith(" ") else "")


def base_rules(rules: list[Rule] | None = None) -> list[int]:
    """Numbers of the rules of the three counted phrases."""
    return [r.number for r in (all_rules() if rules is None else rules) if r.pattern in BASE]


def with_digest(found: DataFrame) -> DataFrame:
    """Counts, labels and score in place of the matches.

    ``n_base, first_word, last_word, base_labels``: places of the counted phrases, kept or
    not.  ``labels``: those and the kept labels.  ``score``: the strongest kept evidence.
    """
    base = F.filter("licenses", lambda m: m["rule"].isin(base_rules()))
    out = found.withColumn("__base", base)
    starts = F.transform("__base", lambda m: m["first_word"])
    base_labels = F.array_distinct(F.transform("__base", lambda m: m["label"]))
    kept = F.filter("licenses", lambda m: m["kept"])
    best = F.array_min(F.transform(kept, lambda m: m["priority"]))
    weight = F.lit(0.0)
    for priority in WEIGHTS:
        weight = F.when(best == priority, F.lit(WEIGHTS[priority])).otherwise(weight)
    columns = {
        "n_base": F.size("__base").cast("long"),
        "first_word": F.array_min(starts),
        "last_word": F.array_max(starts),
        "base_labels": F.array_join(F.array_sort(base_labels), ","),
        "labels": F.array_join(F.array_sort(F.array_union(base_labels, F.transform(kept, lambda m: m["label"]))), ","),
        "score": weight,
    }
    return out.withColumns(columns).drop("__base", "licenses")
