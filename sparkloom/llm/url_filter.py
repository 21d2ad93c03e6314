"""URL filter: host and path rules first, then a weighted vocabulary found by one Aho-Corasick automaton."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from sparkloom.llm.common import ascii_lower

# One strict term is enough: words that hardly stand in the url of anything else. English, German, French, Spanish, Italian and Portuguese.
ADULT = ("adult sex porn porno pornos pornography pornstar xxx xvideo hentai milf blowjob bukkake camgirl camgirls creampie cumshot deepthroat dildo dildos "
         "erotica escort escorts fetish gangbang hardcore hardsex hookup hookups lolita nude nudes nudist orgy porntube sexcam sexcams sexshop sexchat "
         "sextape sexting sexvideos sexy striptease stripper strippers swinger swingers upskirt voyeur whore whores pornofilme sexkontakte hure nutte "
         "erotik nackt salope partouze porrista pornografia prostituta prostitutas puta putas desnuda desnudas sesso troia scopare buceta putaria").split()
GAMBLING = ("casino casinos blackjack baccarat roulette slots slotmachine slotmachines sportsbook sportsbooks bookmaker bookmakers gambling gamble "
            "poker pokerstars jackpots sportwetten spielautomat spielautomaten gluecksspiel wettanbieter tragamonedas apuestas apuesta ruleta "
            "pronostici scommesse cassino apostas").split()
PIRACY = ("warez keygen keygens crackz serialz torrentz nulled cracked camrip dvdrip raubkopie").split()
DRUGS = ("viagra cialis levitra kamagra tramadol xanax phentermine oxycodone hydrocodone ambien modafinil steroids").split()
STRICT = tuple(dict.fromkeys(ADULT + GAMBLING + PIRACY + DRUGS))

# Soft terms count together. Words of a trade that is rarely wanted weigh 0.6, words that sell anything 0.3: two of a trade reach 1.0,
# general words do so only beside a word of a trade, and only several of them.
TRADES = ("amateur anal babe babes bdsm boobs busty cam cams dating erotic fuck gay girls hot hottest kinky lesbian lingerie naked pussy "
          "sexe sexo sexual teens tits bet bets betting bingo bonus bookie freespins jackpot lottery lotto odds slot spins stake "
          "stakes wager wagers wetten loto paris tipster crack cracks hack hacks hacked leak leaked serial torrent torrents unlocker "
          "pharma pharmacy pills pill painkillers prescription rx steroid apotheke pharmacie farmacia pillen malware phishing ransomware spam spammer "
          "spyware trojan clickbait payday forex binary crypto airdrop ponzi replica replicas counterfeit weightloss slimming").split()
SELLING = ("buy cheap cheapest click coupon deal deals discount download earn easy fast free freebie gratis guaranteed hurry instant kaufen kostenlos "
           "limited lose money offer offers online order profit promo quick rich sale unlimited win winner winners now gratuit gratuito "
           "barato billig acheter comprar ganar").split()
SOFT = {t: 0.6 for t in TRADES} | {t: 0.3 for t in SELLING}


@dataclass(frozen=True)
class Vocabulary:
    """Lower-case terms. One strict term rejects; so do ``min_soft`` distinct soft terms that weigh ``min_weight``."""

    strict: tuple[str, ...] = STRICT
    soft: tuple[tuple[str, float], ...] = tuple(SOFT.items())
    min_soft: int = 2
    min_weight: float = 1.0


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_column(rules: list[tuple[str, str, str]], host: Column, path: Column, value) -> Column:
    """``value(verdict, rule)`` of the longest (verdict, host, path) rule that fits, else null."""
    out = F.lit(None).cast("string")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):  # the last put on top is asked first
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.lit(value(verdict, rule_host + rule_path))).otherwise(out)
    return out


def vocabulary_hits(vocabulary: Vocabulary):
    """Column function: distinct strict terms, distinct soft terms and the weight of the soft ones in a lower-case text.

    A term counts only where neither an ASCII letter nor a digit touches it.
    """
    strict, soft = set(vocabulary.strict), dict(vocabulary.soft)

    @F.pandas_udf("strict_hits int, soft_hits int, soft_weight double")
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for term in strict | set(soft):
            automaton.add_word(term, term)
        automaton.make_automaton()

        def inside(c: str) -> bool:
            return c.isascii() and c.isalnum()

        def one(text: str) -> tuple[int, int, float]:
            found = set()
            for end, term in automaton.iter(text) if len(automaton) else ():
                start = end - len(term) + 1
                if not (start and inside(text[start - 1])) and not (end + 1 < len(text) and inside(text[end + 1])):
                    found.add(term)
            light = sorted(found & soft.keys() - strict)
            return len(found & strict), len(light), round(sum(soft[t] for t in light), 6)

        for batch in batches:
            yield pd.DataFrame([one(t) for t in batch], columns=["strict_hits", "soft_hits", "soft_weight"])

    return hits


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], vocabulary: Vocabulary = Vocabulary(),
               id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Verdict (allow or block) for every url; one output row for each input row, other columns are not read.

    The vocabulary sees the whole url, with its query and fragment. A url that is null or empty is allowed; one without
    ``://`` has an empty host and path and fits no rule, but its words count. Repeated rows and ids are judged one by one. Of rules of the same length, the later in the alphabet wins.
    """
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    split = pages.select(F.col(id_col), host.alias("host"), path.alias("path"), F.coalesce(F.col(url_col), F.lit("")).alias("__url"))
    text = ascii_lower(F.col("__url"))
    found = split.select(
        id_col, "host", "path",
        rule_column(rules, F.col("host"), F.col("path"), lambda verdict, rule: rule).alias("rule"),
        rule_column(rules, F.col("host"), F.col("path"), lambda verdict, rule: verdict).alias("by_rule"),
        vocabulary_hits(vocabulary)(text).alias("hits"))
    bad = (F.col("hits.strict_hits") > 0) | (
        (F.col("hits.soft_hits") >= vocabulary.min_soft) & (F.col("hits.soft_weight") >= vocabulary.min_weight))
    return found.select(id_col, "host", "path", "rule",
                        F.coalesce("by_rule", F.when(bad, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
                        "hits.strict_hits", "hits.soft_hits", "hits.soft_weight")


def verdict_sql(rules: list[tuple[str, str, str]], vocabulary: Vocabulary = Vocabulary()) -> str:
    """The same judgement as DuckDB SQL over ``pages``."""
    def hit(term: str) -> str:
        return f"cast(regexp_matches(t, '(^|[^a-z0-9]){term}($|[^a-z0-9])') as int)"

    def case(value) -> str:
        longest_first = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
        whens = " ".join(f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{value(v, h + p)}'"
                         for v, h, p in longest_first)
        return f"case {whens} end"

    strict = " + ".join(hit(t) for t in vocabulary.strict)
    soft = " + ".join(hit(t) for t, _ in vocabulary.soft)
    weight = " + ".join(f"{w}::double * {hit(t)}" for t, w in vocabulary.soft)
    lower = f"translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{'ABCDEFGHIJKLMNOPQRSTUVWXYZ'}', '{'abcdefghijklmnopqrstuvwxyz'}')"
    return f"""
        with split as (select page_id, {lower} as host,
                              coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path, coalesce(url, '') as url from pages),
             lowered as (select *, translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from split),
             hits as (select *, cast({strict} as int) as strict_hits, cast({soft} as int) as soft_hits,
                             round({weight}, 6) as soft_weight from lowered)
        select page_id, host, path, {case(lambda v, r: r)} as rule,
               coalesce({case(lambda v, r: v)}, case when strict_hits > 0
                        or (soft_hits >= {vocabulary.min_soft} and soft_weight >= {vocabulary.min_weight})
                        then 'block' else 'allow' end) as verdict, strict_hits, soft_hits, soft_weight
        from hits"""
