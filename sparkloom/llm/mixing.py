"""Hierarchical token budgets: weights run down a tree of domain, language and source, shortages go to siblings first.

A node never gets more than its subtree can give in ``max_epochs`` passes, and a weight of zero gives nothing. What a child cannot take is shared
among its siblings by weight; only what a whole family cannot take goes to the families beside it. Each leaf
repeats whole epochs and ends with a token-prefix of one more epoch in that epoch's own seeded order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

LEVELS = ("domain", "lang", "source")
SPACE_RUN = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mixture:
    """``weights``: path (domain), (domain, lang) or (domain, lang, source) -> weight among its siblings; ``default`` for all others.
    ``domains``: source -> domain, ``rest`` for all others. ``share``: budget as a share of all tokens."""

    weights: dict[tuple[str, ...], float] = field(default_factory=dict)
    domains: dict[str, str] = field(default_factory=dict)
    rest: str = "collections"
    default: float = 1.0
    share: float = 1.0
    max_epochs: int = 2
    seed: int = 7


def chosen(cases: list[tuple[Column, Column]], otherwise: Column) -> Column:
    out = otherwise
    for condition, value in cases:
        out = F.when(condition, value).otherwise(out)
    return out


def leaves_of(documents: DataFrame, mixture: Mixture) -> list[Column]:
    """Domain, language and source of a row; nulls are empty names."""
    lang, source = F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit(""))
    domain = chosen([(source == s, F.lit(d)) for s, d in mixture.domains.items()], F.lit(mixture.rest))
    return [domain.alias("domain"), lang.alias("lang"), source.alias("source")]


def order_key(epoch: Column, seed: int, doc_id: Column) -> Column:
    """Place of a document in an epoch of its leaf."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def weight_of(depth: int, mixture: Mixture) -> Column:
    cases = [(F.concat_ws("\x01", *LEVELS[:depth]) == "\x01".join(path), F.lit(float(w))) for path, w in mixture.weights.items() if len(path) == depth]
    return chosen(cases, F.lit(mixture.default))


def share_out(children: DataFrame, parents: tuple[str, ...]) -> DataFrame:
    """Adds ``given`` to rows with weight, cap and the parent's budget: shares by weight, none above its cap.

    In the order of cap / weight the children that are filled come first; the rest shares what remains.
    """
    group = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    order = [F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(F.lit(float("inf"))), *LEVELS[:len(parents) + 1]]
    before = group.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rest = F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weights = F.sum("weight").over(group) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    ranked = children.withColumn("rest", rest).withColumn("weights", weights)
    ranked = ranked.withColumn("full", F.col("cap") * F.col("weights") <= F.col("rest") * F.col("weight"))
    level = F.max(F.when(~F.col("full") & (F.col("weights") > 0), F.col("rest") / F.col("weights"))).over(group)
    ranked = ranked.withColumn("level", level)
    return ranked.withColumn("given", F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight")))).drop(
        "rest", "weights", "full", "level")


def budgets(supply: DataFrame, mixture: Mixture) -> DataFrame:
    """One row for each leaf: supply, budget (tokens), whole epochs and the tokens of the last, partial epoch."""
    open_ = (weight_of(1, mixture) > 0) & (weight_of(2, mixture) > 0) & (weight_of(3, mixture) > 0)
    leaves = supply.withColumn("cap", F.when(open_, F.col("supply") * float(mixture.max_epochs)).otherwise(F.lit(0.0)))
    top = leaves.groupBy("domain").agg(F.sum("cap").alias("cap"), F.sum("supply").alias("supply")).withColumn("weight", weight_of(1, mixture))
    all_ = Window.partitionBy(F.lit(0))  # over the few domains
    wanted = F.floor(F.sum("supply").over(all_) * mixture.share).cast("double")
    top = share_out(top.withColumn("budget", F.least(F.sum("cap").over(all_), wanted)), ())
    mid = leaves.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).withColumn("weight", weight_of(2, mixture))
    mid = share_out(mid.join(top.select("domain", F.col("given").alias("budget")), "domain"), ("domain",))
    low = leaves.withColumn("weight", weight_of(3, mixture)).join(mid.select("domain", "lang", F.col("given").alias("budget")), ["domain", "lang"])
    out = share_out(low, ("domain", "lang")).withColumn("budget", F.floor(F.col("given") + 1e-6))
    return out.select(*LEVELS, "supply", "budget", F.floor(F.col("budget") / F.col("supply")).alias("epochs")).withColumn(
        "part", F.col("budget") - F.col("epochs") * F.col("supply"))


def plan(documents: DataFrame, mixture: Mixture, tokens: Column) -> DataFrame:
    """For each leaf its whole epochs and the last key of the partial epoch that still fits (null: none).

    Prefix sums run over narrow rows. A leaf's order is cut into 4096 ranges of its hash key, so a leaf with a third of
    all rows is summed by many tasks. Documents with one id and epoch share a key and are taken or left together.
    """
    rows = documents.select("doc_id", *leaves_of(documents, mixture), tokens.alias("n_tokens"))
    supply = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("supply")).where(F.col("supply") > 0)
    given = budgets(supply, mixture)
    keyed = rows.join(given, [*LEVELS]).withColumn("key", order_key(F.col("epochs"), mixture.seed, F.col("doc_id")))
    # A third of all rows may be one leaf: sums are made by (leaf, range), never by leaf over rows.
    keyed = keyed.withColumn("range", F.substring("key", 1, 3)).select(*LEVELS, "range", "key", "n_tokens", "part")
    sums = keyed.groupBy(*LEVELS, "range", "part").agg(F.sum("n_tokens").alias("range_total"))
    before = Window.partitionBy(*LEVELS).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("range_start", F.coalesce(F.sum("range_total").over(before), F.lit(0)))
    whole = sums.where(F.col("range_start") + F.col("range_total") <= F.col("part")).groupBy(*LEVELS).agg(
        F.concat(F.max("range"), F.lit("g")).alias("cut"))  # "g" sorts after every hexadecimal digit
    edge = sums.where((F.col("range_start") <= F.col("part")) & (F.col("range_start") + F.col("range_total") > F.col("part")))
    inside = keyed.drop("part").join(edge, [*LEVELS, "range"]).groupBy(*LEVELS, "range", "key", "range_start", "part").agg(F.sum("n_tokens").alias("n"))
    so_far = F.col("range_start") + F.sum("n").over(Window.partitionBy(*LEVELS, "range").orderBy("key"))
    partial = inside.withColumn("so_far", so_far).where(F.col("so_far") <= F.col("part")).groupBy(*LEVELS).agg(F.max("key").alias("key_cut"))
    cuts = given.join(whole, [*LEVELS], "left").join(partial, [*LEVELS], "left")
    return cuts.select(*LEVELS, "supply", "budget", "epochs", "part", F.when(F.col("part") > 0, F.greatest("cut", "key_cut")).alias("cut"))


def take(documents: DataFrame, mixture: Mixture, tokens: Column | None = None) -> DataFrame:
    """(doc, domain, lang, source, epoch): the rows of ``documents`` as a struct, once for each epoch that takes them.

    Rows without tokens (null or empty texts) belong to no budget and are left out; nulls in lang and source are empty
    names. Repeated rows are documents of their own, but those with one id are taken together. An empty table gives none.
    """
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(SPACE_RUN)).cast("long")
    tokens = words if tokens is None else tokens
    planned = plan(documents, mixture, tokens)
    whole = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("doc"), *leaves_of(documents, mixture), tokens.alias("n_tokens"))
    rows = whole.where(F.col("n_tokens") > 0).join(planned.drop("supply", "budget", "part"), [*LEVELS])
    last = F.col("cut").isNotNull() & (order_key(F.col("epochs"), mixture.seed, F.col("doc.doc_id")) <= F.col("cut"))
    copies = F.col("epochs") + last.cast("long")
    return rows.where(copies > 0).select("doc", *LEVELS, "n_tokens", F.explode(F.sequence(F.lit(1).cast("long"), copies)).alias("epoch"))


def mix_documents(documents: DataFrame, mixture: Mixture) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens and epoch (from 1) of every document taken."""
    return take(documents.select("doc_id", "text", "lang", "source"), mixture).select("doc.doc_id", *LEVELS, "n_tokens", "epoch")


def mixed_rows(documents: DataFrame, mixture: Mixture) -> DataFrame:
    """The rows taken, with all their columns; a row taken in several epochs comes several times."""
    return take(documents, mixture).select("doc.*")


def mixture_sql(mixture: Mixture) -> str:
    """The same mixture as DuckDB SQL over ``documents``."""
    domain = "case " + " ".join(f"when source = '{s}' then '{d}'" for s, d in mixture.domains.items()) + f" else '{mixture.rest}' end" \
        if mixture.domains else f"'{mixture.rest}'"

    def weight(depth: int) -> str:
        cases = " ".join("when " + " and ".join(f"{c} = '{v}'" for c, v in zip(LEVELS, path, strict=False)) + f" then {float(w)}::double"
                         for path, w in mixture.weights.items() if len(path) == depth)
        return f"case {cases} else {mixture.default}::double end" if cases else f"{mixture.default}::double"

    def shared(name: str, source: str, parents: str, names: str) -> str:
        part = f"partition by {parents}" if parents else ""
        return f"""
          {name}_a as (select *, budget - coalesce(sum(cap) over before, 0) as rest,
                              sum(weight) over ({part}) - coalesce(sum(weight) over before, 0) as weights from {source}
                       window before as ({part} order by case when weight > 0 then cap / weight else 'inf'::double end, {names}
                                         rows between unbounded preceding and 1 preceding)),
          {name}_b as (select *, cap * weights <= rest * weight as filled from {name}_a),
          {name}_c as (select *, max(case when not filled and weights > 0 then rest / weights end) over ({part}) as lvl from {name}_b),
          {name} as (select * exclude (rest, weights, filled, lvl), case when filled then cap else least(cap, lvl * weight) end as given from {name}_c)"""

    return f"""
        with d as (select doc_id, {domain} as domain, coalesce(lang, '') as lang, coalesce(source, '') as source,
                          len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as n_tokens from documents),
          supplies as (select domain, lang, source, sum(n_tokens)::double as supply from d group by all having sum(n_tokens) > 0),
          leaf as (select *, case when {weight(1)} > 0 and {weight(2)} > 0 and {weight(3)} > 0
                          then supply * {float(mixture.max_epochs)}::double else 0 end as cap from supplies),
          top_in as (select domain, sum(cap) as cap, {weight(1)} as weight,
                            (select least(sum(cap), floor(sum(supply) * {mixture.share}::double)) from leaf) as budget from leaf group by domain),
          {shared("top", "top_in", "", "domain")},
          mid_in as (select leaf.domain, lang, sum(leaf.cap) as cap, {weight(2).replace("domain", "leaf.domain")} as weight, any_value(given) as budget
                     from leaf join top using (domain) group by leaf.domain, lang),
          {shared("mid", "mid_in", "domain", "domain, lang")},
          low_in as (select leaf.*, {weight(3).replace("domain", "leaf.domain").replace("lang", "leaf.lang")} as weight, mid.given as budget
                     from leaf join mid on leaf.domain = mid.domain and leaf.lang = mid.lang),
          {shared("low", "low_in", "domain, lang", "domain, lang, source")},
          plan as (select domain, lang, source, floor(floor(given + 1e-6) / supply)::bigint as epochs,
                          floor(given + 1e-6) - floor(floor(given + 1e-6) / supply) * supply as part from low),
          keyed as (select d.*, epochs, part, md5('{mixture.seed}|' || epochs || '|' || coalesce(cast(doc_id as varchar), '')) as key
                    from d join plan using (domain, lang, source) where n_tokens > 0),
          summed as (select *, sum(n_tokens) over (partition by domain, lang, source order by key range between unbounded preceding and current row) as so_far from keyed)
        select doc_id, domain, lang, source, n_tokens, unnest(range(1, 1 + epochs + case when part > 0 and so_far <= part then 1 else 0 end)) as epoch from summed"""
