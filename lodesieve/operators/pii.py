"""Personal data with checksums, a category of its own and opt-in."""

from __future__ import annotations

import hashlib
from dataclasses import replace
from itertools import groupby
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodesieve.catalog.rules import PII_RULES, SEED_PHRASE_RULE, Rule
from lodesieve.functions.text import iban_valid, luhn_valid
from lodesieve.operators.extract import explode_hits, passes_gate, rule_hits

VALIDATORS = {"credit_card_number": luhn_valid, "iban": iban_valid}

# Phrase lengths, longest first, and bits per word.
PHRASE_LENGTHS = (24, 21, 18, 15, 12)
WORD_BITS = 11
WORDLIST_SIZE = 2048


def pii_hits(text: Column, rules: tuple[Rule, ...] = PII_RULES) -> Column:
    """Array of hits whose checksum holds; an invalid one is simply no match."""
    checked = tuple(r if r.validate else replace(r, validate=VALIDATORS.get(r.id)) for r in rules)
    return rule_hits(text, checked, pass_name="pii")


def scan_pii(records: DataFrame, rule_ids: Iterable[str] | None = None, wordlist: list[str] | None = None) -> DataFrame:
    """Personal data in records: SSN, card number, IBAN and, given a word list, seed phrases."""
    rules = tuple(r for r in PII_RULES if rule_ids is None or r.id in rule_ids)
    parts = []
    if rules:
        gated = records.where(passes_gate(F.col("text"), rules))
        parts.append(explode_hits(gated, pii_hits(F.col("text"), rules)))
    if wordlist and (rule_ids is None or SEED_PHRASE_RULE.id in rule_ids):
        parts.append(scan_seed_phrases(records, wordlist))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def read_wordlist(spark: SparkSession, path: str) -> list[str]:
    """The 2,048 words of a mnemonic list, one per line, in order."""
    words = [r.value for r in spark.read.text(path).limit(WORDLIST_SIZE + 1).collect() if r.value]
    if len(words) != WORDLIST_SIZE:
        raise ValueError(f"a mnemonic word list has {WORDLIST_SIZE} words, {path} has {len(words)}")
    return words


def checksum_holds(indices: list[int]) -> bool:
    """Do the last bits of a phrase equal the first bits of the hash of the others?"""
    check_bits = len(indices) // 3
    bits = 0
    for index in indices:
        bits = bits << WORD_BITS | index
    entropy, check = bits >> check_bits, bits & ((1 << check_bits) - 1)
    digest = hashlib.sha256(entropy.to_bytes((len(indices) * WORD_BITS - check_bits) // 8, "big")).digest()
    return int.from_bytes(digest, "big") >> (256 - check_bits) == check


def phrases_in(run: str, index_of: dict[str, int]) -> list[str]:
    """The valid phrases inside a run of lower-case words: from the left, longest first, without overlap."""
    found, words = [], run.split(" ")
    for listed, stretch in groupby(enumerate(words), key=lambda w: w[1] in index_of):
        at = [i for i, _ in stretch] if listed else []
        numbers = [index_of[words[i]] for i in at]
        start = 0
        while len(at) - start >= PHRASE_LENGTHS[-1]:
            size = next((n for n in PHRASE_LENGTHS if start + n <= len(at) and checksum_holds(numbers[start:start + n])), None)
            if size:
                found.append(" ".join(words[at[start]:at[start] + size]))
            start += size or 1
    return found


def narrow_seed_phrases(matches: DataFrame, wordlist: list[str]) -> DataFrame:
    """Reduce runs of words to the valid phrases inside; runs without one are dropped.

    The checksum needs numbers of 132 to 264 bits, so this is the one personal-data
    rule with a Python function.  It sees runs of twelve or more lower-case words,
    and NULL for the matches of every other rule.
    """
    if len(wordlist) != WORDLIST_SIZE:
        raise ValueError(f"a mnemonic word list has {WORDLIST_SIZE} words")
    index_of = {w: i for i, w in enumerate(wordlist)}

    @F.pandas_udf("array<string>")
    def phrases(runs: pd.Series) -> pd.Series:
        return runs.map(lambda run: None if run is None else phrases_in(run, index_of))

    is_run = F.col("rule_id") == SEED_PHRASE_RULE.id
    narrowed = matches.withColumn("_phrases", phrases(F.when(is_run, F.col("value"))))
    return narrowed.withColumn("value", F.explode(F.when(is_run, F.col("_phrases")).otherwise(F.array("value")))).drop("_phrases")


def scan_seed_phrases(records: DataFrame, wordlist: list[str]) -> DataFrame:
    """Wallet seed phrases; the reported value is narrowed to the valid phrase."""
    gated = records.where(passes_gate(F.col("text"), (SEED_PHRASE_RULE,)))
    runs = explode_hits(gated, rule_hits(F.col("text"), (SEED_PHRASE_RULE,), pass_name="pii"))
    return narrow_seed_phrases(runs, wordlist)
