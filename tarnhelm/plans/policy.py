"""Access tokens, key shares, operator budgets and governed frames.

A token names a user, a nonce, a budget of operators and the user's key share; the owner
signs it.  Opening a token checks the signature and that the nonce is newer than any seen
from that user, and rebuilds the table key from the user's share and the owner's.  Filter,
project, aggregate and join cost one unit each; scans, sorts and unions are free.
"""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import os
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnhelm.operators import relational as R
from tarnhelm.plans.sqlguard import QueryRefused, check, record
from tarnhelm.plans.trace import Trace
from tarnhelm.sources.sealed import read_sealed


class PolicyError(PermissionError):
    """A token is forged, stale or spent."""


@dataclass(frozen=True)
class Token:
    uid: str
    nonce: int
    budget: int
    share: bytes

    def sealed(self, secret: bytes) -> str:
        body = json.dumps({"uid": self.uid, "c": self.nonce, "w": self.budget, "sk": self.share.hex()}, sort_keys=True).encode()
        return ".".join(base64.urlsafe_b64encode(x).decode() for x in (body, hmac.digest(secret, body, "sha256")))

    @staticmethod
    def opened(text: str, secret: bytes) -> Token:
        try:
            body, mac = (base64.urlsafe_b64decode(x) for x in text.split("."))
        except ValueError as e:
            raise PolicyError("the token can't be read") from e
        if not hmac.compare_digest(mac, hmac.digest(secret, body, "sha256")):
            raise PolicyError("the token's signature is wrong")
        x = json.loads(body)
        return Token(x["uid"], x["c"], x["w"], bytes.fromhex(x["sk"]))


def _xor(a: bytes, b: bytes) -> bytes:
    return bytes(x ^ y for x, y in zip(a, b, strict=True))


class KeyRegistry:
    """The owner's side: each user's key share has a counterpart here; neither alone is the key."""

    def __init__(self, key: bytes, secret: bytes | None = None):
        self._key_print = hashlib.sha256(key).digest()
        self._key, self._secret = key, secret or os.urandom(32)
        self._counterpart: dict[str, bytes] = {}
        self._last: dict[str, int] = {}

    def grant(self, uid: str, nonce: int, budget: int) -> str:
        """A sealed token with a fresh share; earlier shares of this user stop working."""
        share = os.urandom(len(self._key))
        self._counterpart[uid] = _xor(self._key, share)
        return Token(uid, nonce, budget, share).sealed(self._secret)

    def revoke(self, uid: str) -> None:
        self._counterpart.pop(uid, None)

    def open(self, text: str) -> PolicyContext:
        t = Token.opened(text, self._secret)
        if t.uid not in self._counterpart:
            raise PolicyError(f"unknown user {t.uid!r}")
        key = _xor(self._counterpart[t.uid], t.share)
        if hashlib.sha256(key).digest() != self._key_print:
            raise PolicyError("the share doesn't give the key")
        if t.nonce <= self._last.get(t.uid, -1):
            raise PolicyError("the token isn't fresh")
        self._last[t.uid] = t.nonce
        return PolicyContext(t.uid, t.nonce, t.budget, key)


@dataclass
class PolicyContext:
    """What one query may still do, and what it has done.  Lives on the driver."""

    uid: str
    nonce: int
    budget: int
    key: bytes = field(repr=False)
    trace: Trace = field(default_factory=Trace)

    def charge(self, op: str, *inputs: int, cost: int = 1) -> int:
        if self.budget < cost:
            raise PolicyError(f"{op} refused: budget {self.budget} is below {cost}")
        self.budget -= cost
        return self.trace.add(op, *inputs)

    def apply(self, df: DataFrame) -> GovernedFrame:
        """Put a frame under this policy."""
        return GovernedFrame(df, self, self.trace.add("scan"))

    def scan(self, spark: SparkSession, path: str, table: str, columns: Sequence[str] | None = None) -> GovernedFrame:
        return self.apply(read_sealed(spark, path, self.key, table, columns))


@dataclass(frozen=True)
class GovernedFrame:
    """A DataFrame whose operators are charged to a policy and recorded in its trace."""

    df: DataFrame
    policy: PolicyContext
    node: int

    def _next(self, df: DataFrame, node: int) -> GovernedFrame:
        return GovernedFrame(df, self.policy, node)

    def _same(self, other: GovernedFrame) -> None:
        if other.policy is not self.policy:
            raise PolicyError("both sides must be under one policy")

    def filter(self, cond: Column | str) -> GovernedFrame:
        node = self.policy.charge("filter", self.node)
        return self._next(R.where(self.df, cond), node)

    def select(self, *cols: Column | str) -> GovernedFrame:
        node = self.policy.charge("project", self.node)
        return self._next(R.project(self.df, *cols), node)

    def aggregate(self, keys: Sequence[Column | str], *aggs: Column) -> GovernedFrame:
        node = self.policy.charge("aggregate", self.node)
        return self._next(R.aggregate(self.df, keys, *aggs), node)

    def distinct(self) -> GovernedFrame:
        node = self.policy.charge("aggregate", self.node)
        return self._next(R.distinct(self.df), node)

    def join(self, other: GovernedFrame, on, how: str = "inner") -> GovernedFrame:
        self._same(other)
        node = self.policy.charge("join", self.node, other.node)
        return self._next(R.join(self.df, other.df, on, how), node)

    def union(self, other: GovernedFrame) -> GovernedFrame:
        self._same(other)
        return self._next(R.union_all(self.df, other.df), self.policy.trace.add("union", self.node, other.node))

    def sort(self, *order: Column | str) -> GovernedFrame:
        return self._next(R.sort(self.df, *order), self.node)

    def limit(self, n: int) -> GovernedFrame:
        return self._next(self.df.limit(n), self.node)

    def persist(self) -> GovernedFrame:
        return self._next(R.persist(self.df), self.node)

    def prepare_result(self) -> tuple[DataFrame, Trace]:
        """The plain rows and the trace that led to them."""
        self.policy.trace.add("result", self.node)
        return self.df, self.policy.trace


def plan_operators(df: DataFrame) -> list[str]:
    """Charged operators of the analyzed plan, from the leaves up (independent of the optimizer); a view is a leaf."""
    ops: list[str] = []

    def charge(op: str, *inputs: int) -> int:
        ops.append(op)
        return 0

    record(df, lambda *_: 0, charge)
    return ops


def governed_sql(spark: SparkSession, policy: PolicyContext, sql: str, tables: dict[str, DataFrame]) -> GovernedFrame:
    """Run a query over named frames; each charged operator of its analyzed plan costs one unit.

    Only queries over these names pass (``QueryRefused`` otherwise), and everything is paid for
    before the frame is handed out.  The names are views while the text is analyzed, and are
    dropped then; views of the same name that the frames' session had are gone too, so serve
    requests from a session of their own.
    """
    if strange := check(spark, sql) - {n.lower() for n in tables}:
        raise QueryRefused(f"unknown table: {', '.join(sorted(strange))}")
    try:
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
        out = spark.sql(sql)
    finally:
        for name in tables:
            spark.catalog.dropTempView(name)
    return GovernedFrame(out, policy, record(out, policy.trace.add, policy.charge))


def trace_frame(spark: SparkSession, trace: Trace) -> DataFrame:
    return spark.createDataFrame(trace.rows(), "node INT, op STRING, left_input INT, right_input INT").orderBy(F.col("node"))
