"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression over ``host + path`` of a url, with the literal
tokens (runs of ``[a-z0-9]``, lower case) that every matching url contains. The
tokens of all rules are counted over the urls (partial counts in the tasks, one
row per rule token after that). Each rule is then filed under its rarest token.
A url looks up its own tokens and runs the expressions of the fetched rules
only. Rules without a literal token are run on every url.

Rules are a list on the driver. They go to the tasks in blocks of
``block_rules``, one map-only pass after another, so a broadcast never exceeds
that many rules, whatever the length of the list. Urls are never shuffled.

Null or malformed urls (no ``://``): empty host and path, only rules that match
the empty string can fit. Empty table: no rows. Repeated rows are judged each on
their own. Ties in length go to the rule that stands first in the list.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = re.compile(r"[a-z0-9]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
BLOCK_RULES = 50_000


class Rule(NamedTuple):
    name: str
    verdict: str
    pattern: str          # searched in host + path
    tokens: tuple[str, ...]
    length: int           # the longest fitting rule wins


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path as the contract cuts them."""
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    rest = re.split(r"[?#]", url[at + 3:], maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """A rule that fits ``host`` and its subdomains where the path starts with ``path``."""
    pattern = rf"\A(?:[^/]*\.)?{re.escape(host)}" + (re.escape(path) if path else r"(?=/|\Z)")
    closed = path[:path.rfind("/") + 1]  # what follows may be the start of a longer token, so it isn't a key
    return Rule(host + path, verdict, pattern, tuple(dict.fromkeys(TOKEN.findall((host + closed).translate(_LOWER)))),
                len(host + path))


def word_rule(verdict: str, word: str) -> Rule:
    """A rule that fits wherever ``word`` stands as a whole token of host or path, in any case."""
    pattern = rf"(?<![A-Za-z0-9])(?ai:{re.escape(word)})(?![A-Za-z0-9])"
    return Rule(word, verdict, pattern, (word,), len(word))


def token_counts(urls: DataFrame, rules: Sequence[Rule], column: str = "url",
                 block_rules: int = BLOCK_RULES) -> dict[str, int]:
    """In how many urls each rule token stands: at most one count per rule token reaches the driver."""
    counts: dict[str, int] = {}
    for at in range(0, len(rules), block_rules):
        wanted = frozenset(t for r in rules[at:at + block_rules] for t in r.tokens)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: Counter = Counter()
            for b in batches:
                for url in b.column(0).to_pylist():
                    found.update(wanted.intersection(TOKEN.findall("".join(split_url(url)).translate(_LOWER))))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()),
                                              pa.array(list(found.values()), pa.int64())], names=["token", "n"])

        per_task = urls.select(column).mapInArrow(count, "token string, n bigint")
        counts |= {r.token: r.n for r in per_task.groupBy("token").agg(F.sum("n").alias("n")).collect()}
    return counts


def rarest_token_index(rules: Sequence[Rule], counts: dict[str, int]) -> dict[str, list[int]]:
    """Token -> numbers of the rules filed under it; '' holds the rules without a literal token."""
    index: dict[str, list[int]] = {}
    for i, r in enumerate(rules):
        index.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), t), default=""), []).append(i)
    return index


def judge(urls: DataFrame, rules: Sequence[Rule], prefix: str, column: str = "url",
          block_rules: int = BLOCK_RULES, counts: dict[str, int] | None = None) -> DataFrame:
    """Add ``{prefix}_rule``, ``{prefix}_verdict`` (longest fitting rule, else null), ``{prefix}_length`` and
    ``{prefix}_tried`` (expressions run) to ``urls``; a later block only overrides with a longer rule."""
    added = [f"{prefix}_{x}" for x in ("rule", "verdict", "length", "tried")]
    out = urls.drop(*added).select("*", *[F.lit(None).cast(t).alias(n) for n, t in
                                          zip(added, ("string", "string", "int", "int"), strict=True)])
    schema = T.StructType(out.schema.fields)
    counts = token_counts(urls, rules, column, block_rules) if counts is None else counts
    for at in range(0, max(1, len(rules)), block_rules):
        block = list(rules[at:at + block_rules])
        index = rarest_token_index(block, counts)

        def run(batches: Iterator[pa.RecordBatch], block=block, index=index) -> Iterator[pa.RecordBatch]:
            compiled = [re.compile(r.pattern) for r in block]
            always = index.get("", [])
            for b in batches:
                where = [b.schema.get_field_index(x) for x in (column, *added)]
                cols = [b.column(i).to_pylist() for i in where]
                got: list[list] = [[], [], [], []]
                for url, *best in zip(*cols, strict=True):
                    subject = "".join(split_url(url))
                    tokens = set(TOKEN.findall(subject.translate(_LOWER)))
                    fetched = sorted([*always, *(i for t in tokens if t in index for i in index[t])])
                    for i in fetched:
                        if (best[2] is None or block[i].length > best[2]) and compiled[i].search(subject):
                            best[:3] = block[i].name, block[i].verdict, block[i].length
                    best[3] = (best[3] or 0) + len(fetched)
                    for values, x in zip(got, best, strict=True):
                        values.append(x)
                arrays = list(b.columns)
                for i, values in zip(where[1:], got, strict=True):
                    arrays[i] = pa.array(values, b.schema.field(i).type)
                yield pa.RecordBatch.from_arrays(arrays, schema=b.schema)

        out = out.mapInArrow(run, schema)
    return out


def url_parts(urls: DataFrame, column: str = "url") -> DataFrame:
    """Add ``host`` and ``path``, with built-in functions only."""
    url = F.col(column)
    rest = F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3))
    cut = F.coalesce(F.regexp_extract(rest, r"^[^?#]*", 0), F.lit(""))
    return urls.withColumns({
        "host": F.translate(F.regexp_extract(cut, r"^[^/]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
        "path": F.regexp_extract(cut, r"^[^/]*((?s:.*))$", 1),
    })


#: The contract's host rules and the method's own words: urls that neither fits are allowed.
CONTRACT_RULES = (
    host_rule("allow", "com", "/"),
    host_rule("block", "example.com", "/en/"),
    host_rule("allow", "www.example.com", "/en/"),
    host_rule("block", "net", "/es/"),
    host_rule("block", "net", "/fr/"),
)
DEFAULT_RULES = tuple(word_rule("block", w) for w in ("casino", "poker", "betting", "porn", "xxx", "warez", "torrent"))


def filter_urls(pages: DataFrame, rules: Sequence[Rule] = CONTRACT_RULES, own: Sequence[Rule] = DEFAULT_RULES,
                column: str = "url") -> DataFrame:
    """Verdict of each row's url: the longest fitting rule's, else that of the method's own patterns, else allow.

    Keeps the key columns and adds host, path, rule, verdict, own_rule and tried.
    """
    counts = token_counts(pages, [*rules, *own], column)
    out = judge(judge(pages, rules, "_given", column, counts=counts), own, "_own", column, counts=counts)
    return url_parts(out.drop("host", "path"), column).withColumns({
        "rule": F.col("_given_rule"),
        "verdict": F.coalesce("_given_verdict", "_own_verdict", F.lit("allow")),
        "own_rule": F.when(F.col("_given_rule").isNull(), F.col("_own_rule")),
        "tried": F.col("_given_tried") + F.col("_own_tried"),
    }).drop(*[f"{p}_{x}" for p in ("_given", "_own") for x in ("rule", "verdict", "length", "tried")])
