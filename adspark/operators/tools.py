"""The query tools: search, full records, counts and pay per group, and words looked up in the dictionaries.

Each tool is a lazy plan over the clean table and the index; only its small result reaches the driver, where it becomes a
dict that can be written as JSON. Mistakes in arguments come back as {"error": …} instead of raising.
"""

from __future__ import annotations

import dataclasses
import json
import re
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adspark.functions.text import fold_query, fold_spelling
from adspark.operators import index as ix
from adspark.operators.aggregate import ORDERED, AggregateSpec, aggregate, top_groups
from adspark.operators.filters import BENEFITS, FilterSpec

MOST_HITS, MOST_ADS, MOST_TERMS, TEXT_SHOWN = 25, 10, 20, 4000
LEMMAS, SPELLINGS, MODERN, CATEGORIES, TAGS = 15, 8, 4, 3, 15  # lengths of the lists that expand_concept reports
GROUPS = ("none", "decade", "year", "label", "newspaper", "position_category", "position_lemma", "position_modern", "position_gender", "requirement_dimension", "requirement_value", "benefit")


def plain(v: Any) -> Any:
    """A value as JSON has it: rows as dicts, dates as text, fractions with two decimals."""
    if isinstance(v, bool) or v is None or isinstance(v, (int, str)):
        return v
    if isinstance(v, float):
        return round(v, 2)
    if hasattr(v, "asDict"):
        return {k: plain(x) for k, x in v.asDict().items()}
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v)[:10] if hasattr(v, "isoformat") else float(v)


def matching_clusters(searchable: DataFrame, q: str) -> DataFrame:
    """The printing clusters of all searchable ads that match a keyword query."""
    return ix.keyword(searchable, q).select("dup_cluster_id").distinct()


def restricted(df: DataFrame, searchable: DataFrame, keyword: str | None) -> DataFrame:
    """Rows whose cluster has a printing that matches; all without a keyword."""
    return df.join(matching_clusters(searchable, keyword), "dup_cluster_id", "left_semi") if keyword else df


def concept_words(term: str) -> list[str]:
    return re.findall(r"[^\W_]+", fold_query(term))


def holds_all(column: str, words: list[str]) -> Column:
    """Whether the folded value contains every word."""
    folded = fold_spelling(F.col(column))
    out = F.lit(True)
    for w in words:
        out = out & folded.contains(w)
    return F.coalesce(out, F.lit(False))


def concept_lemmas(positions: DataFrame, clean: DataFrame, term: str) -> DataFrame:
    """(lemma, n_ads): lemmas of countable ads whose lemma, modern name or term holds all words of the concept."""
    words = concept_words(term)
    hit = holds_all("lemma", words) | holds_all("modern", words) | holds_all("term", words)
    counted = positions.join(clean.where("countable").select("ad_id"), "ad_id", "left_semi")
    lemmas = counted.where(hit & F.col("lemma").isNotNull()).select("lemma").distinct()
    return counted.join(lemmas, "lemma", "left_semi").groupBy("lemma").agg(F.countDistinct("ad_id").alias("n_ads"))


def concept_tags(requirements: DataFrame, clean: DataFrame, term: str) -> DataFrame:
    """(dimension, value, n_ads): requirement values of countable ads that hold all words of the concept."""
    counted = requirements.join(clean.where("countable").select("ad_id"), "ad_id", "left_semi")
    return counted.where(F.col("value").isNotNull() & holds_all("value", concept_words(term))).groupBy("dimension", "value").agg(F.countDistinct("ad_id").alias("n_ads"))


class Tools:
    """The tools over a clean table, the mentions of positions and requirements, and (built from the clean table) an index."""

    def __init__(self, clean: DataFrame, positions: DataFrame, requirements: DataFrame, index: DataFrame | None = None):
        self.clean, self.positions, self.requirements = clean, positions, requirements
        self.index = index if index is not None else ix.rows(clean)

    # ---- calls

    NAMES = {
        "search_ads": {"query": str, "filters": dict, "k": int},
        "get_ad": {"ad_ids": list},
        "aggregate": {"measure": str, "group_by": str, "filters": dict, "subset": dict, "dimension": str},
        "expand_concept": {"terms": list},
    }
    JSON = {str: "string", int: "integer", list: "array", dict: "object"}

    def specs(self) -> list[dict]:
        """The tools and their arguments in the form that function-calling interfaces take."""
        out = []
        for name, arguments in self.NAMES.items():
            properties = {a: {"type": self.JSON[t]} for a, t in arguments.items()}
            out.append({"type": "function", "function": {"name": name, "description": (getattr(self, name).__doc__ or "").split("\n")[0], "parameters": {"type": "object", "properties": properties}}})
        return out

    def call(self, name: str, arguments: str | dict) -> dict:
        """Run a tool by name with JSON or a dict; whatever is wrong with the call is the result's error."""
        if name not in self.NAMES:
            return {"error": f"unknown tool {name!r}; there are {', '.join(self.NAMES)}"}
        try:
            a = json.loads(arguments) if isinstance(arguments, str) else dict(arguments)
            for k, v in a.items():
                if k not in self.NAMES[name]:
                    raise ValueError(f"unknown argument {k!r}")
                if v is not None and not isinstance(v, self.NAMES[name][k]):
                    raise ValueError(f"{k} must be {self.JSON[self.NAMES[name][k]]}")
            return getattr(self, name)(**a)
        except (ValueError, TypeError) as e:
            return {"error": f"{type(e).__name__}: {e}"}

    @staticmethod
    def _filters(given: dict | None) -> tuple[FilterSpec, str | None]:
        given = dict(given or {})
        keyword = given.pop("keyword", None)
        unknown = set(given) - {f.name for f in dataclasses.fields(FilterSpec)}
        if unknown:
            raise ValueError(f"unknown filter {sorted(unknown)[0]!r}")
        return FilterSpec(**given), keyword

    # ---- tools

    def search_ads(self, query: str, filters: dict | None = None, k: int = 10) -> dict:
        """Ads that match a keyword query, best first, one per printing cluster, with the number of all matches."""
        if not 1 <= k <= MOST_HITS:
            raise ValueError(f"k must be between 1 and {MOST_HITS}")
        spec, keyword = self._filters(filters)
        hits = ix.best_printings(ix.ranked(restricted(self.index.where(spec.column()), self.index, keyword), query)).cache()
        n = hits.agg(F.count("*").alias("n"), F.count_if("countable").alias("c")).first()
        shown = hits.orderBy(F.desc(F.round("score", 9)), "ad_id").limit(k).select("ad_id", "date", "label", F.col("position_modern").alias("positions"), F.col("text_norm").alias("text"), F.col("dup_cluster_size").alias("printings"), F.col("quality_warning").alias("warning"))
        out = {"query": query, "total_matches": n["n"], "total_countable": n["c"], "results": [{a: b for a, b in plain(r).items() if a != "warning" or b} for r in shown.collect()]}
        hits.unpersist()
        return out if n["n"] else out | {"hint": "no match; try fewer words, a prefix with * or an OR group"}

    def get_ad(self, ad_ids: list[str]) -> dict:
        """Full records in the order asked for; unknown identifiers are reported."""
        if not 1 <= len(ad_ids) <= MOST_ADS:
            raise ValueError(f"ask for 1 to {MOST_ADS} ads")
        found = {r["ad_id"]: plain(r) for r in self.clean.where(F.col("ad_id").isin(ad_ids)).collect()}  # at most as many as asked for
        return {"ads": [self._record(found[i]) if i in found else {"ad_id": i, "error": "not found"} for i in ad_ids]}

    @staticmethod
    def _record(r: dict) -> dict:
        text = "\n".join(t for t in (r["heading_text"], r["text_norm"]) if t)
        out = {c: r[c] for c in ("ad_id", "newspaper", "date", "page", "label", "lang")}
        out |= {"text": text if len(text) <= TEXT_SHOWN else text[:TEXT_SHOWN] + " …", "image": r["iiif_link"]}
        out |= {"positions_historical": r["position_terms"] or [], "positions_modern": r["position_modern"] or [], "position_categories": r["position_categories"] or []}
        out |= {"requirements": [{k: t[k] for k in ("dimension", "value", "detail") if t[k]} for t in r["requirements"] or []], "benefits": [b for b in BENEFITS if r[f"benefit_{b}"]]}
        out |= {"printings": {"count": r["dup_cluster_size"], "first": r["run_first_date"], "last": r["run_last_date"]}, "countable": bool(r["countable"]), "searchable": bool(r["searchable"])}
        if r["pay_min"] is not None:
            out["pay"] = {c: r[f"pay_{c}"] for c in ("min", "max", "currency", "standard", "period")}
        out["amounts"] = [{k: v for k, v in a.items() if v is not None} for a in r["salary_amounts"] or []]
        return out | ({"warning": r["quality_warning"]} if r["quality_warning"] else {})

    def aggregate(self, measure: str = "count", group_by: str = "none", filters: dict | None = None, subset: dict | None = None, dimension: str | None = None) -> dict:
        """Number, share or pay of countable ads per group, with the number of ads behind it and of groups not shown."""
        if measure not in ("count", "share", "pay") or group_by not in GROUPS:
            raise ValueError(f"measure is count, share or pay; group_by is one of {', '.join(GROUPS)}")
        if measure == "share" and subset is None:
            raise ValueError("a share needs a subset")
        spec, keyword = self._filters(filters)
        base = restricted(self.clean.where("searchable").where(spec.column()), self.index, keyword)
        part: FilterSpec | None = None
        if subset is not None:
            part, word = self._filters(subset)
            if word:
                mark = matching_clusters(self.index, word).withColumn("_in", F.lit(True))
                base = base.join(mark, "dup_cluster_id", "left")
                part = dataclasses.replace(part, where=" and ".join(filter(None, (part.where, "coalesce(_in, false)"))))
        counted = base.where("countable")
        rows = aggregate(counted, AggregateSpec(measure, group_by, FilterSpec(), part, dimension)).cache()
        total = rows.count()
        shown = top_groups(rows, group_by, measure).collect()
        out = {"measure": measure, "group_by": group_by, "n_ads": counted.count(), "groups_total": total}
        if part is not None:
            out["n_subset"] = counted.where(part.column()).count()
        if measure == "pay":
            out["n_ads_with_pay"] = counted.where("pay_min is not null").count()
        if len(shown) < total and group_by not in ORDERED:
            out["groups_omitted"] = total - len(shown)
        rows.unpersist()
        return out | {"rows": [{("group" if c == "g" else c): v for c, v in plain(r).items()} for r in shown]}

    def expand_concept(self, terms: list[str]) -> dict:
        """Lemmas, spellings and requirement tags under which a concept stands in the dictionaries, with their ads."""
        if not 1 <= len(terms) <= MOST_TERMS:
            raise ValueError(f"ask for 1 to {MOST_TERMS} terms")
        return {"results": [self._expand(t) for t in terms]}

    def _expand(self, term: str) -> dict:
        if not concept_words(term):
            return {"term": term, "error": "empty term"}
        top = concept_lemmas(self.positions, self.clean, term).orderBy(F.desc("n_ads"), "lemma").limit(LEMMAS).collect()
        counted = self.positions.join(self.clean.where("countable").select("ad_id"), "ad_id", "left_semi").where(F.col("lemma").isin([r["lemma"] for r in top]))
        about: dict[str, dict[str, list[str]]] = {r["lemma"]: {} for r in top}
        for column, most in (("surface", SPELLINGS), ("modern", MODERN), ("category", CATEGORIES)):
            n = counted.where(F.col(column).isNotNull()).groupBy("lemma", column).agg(F.countDistinct("ad_id").alias("n"))
            best = n.groupBy("lemma").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col(column).alias("v")))), 1, most).alias("x"))  # spellings of fifteen lemmas
            for r in best.collect():
                about[r["lemma"]][column] = [x["v"] for x in r["x"]]
        tags = concept_tags(self.requirements, self.clean, term).orderBy(F.desc("n_ads"), "dimension", "value").limit(TAGS).collect()
        lemmas = [{"lemma": r["lemma"], "n_ads": r["n_ads"], "modern": about[r["lemma"]].get("modern", []), "categories": about[r["lemma"]].get("category", []), "spellings_in_ads": about[r["lemma"]].get("surface", [])} for r in top]
        return {"term": term, "positions": lemmas, "requirements": [{"tag": f"{r['dimension']}:{r['value']}", "n_ads": r["n_ads"]} for r in tags]}
