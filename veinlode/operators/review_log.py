"""Reviews in order: every request of a batch sees what the ones before it have done.

A candidate's decisions are a chain (each one's id holds the id before it), so its requests are folded in the order of
``seq``. Candidates are dealt by hash and sorted inside their partition; one pass over the sorted rows carries the
state of a single candidate along, so a candidate with very many requests costs time but no memory, and no group is
gathered. ``decide`` is the one transition; ``review_stream`` runs it over a stream with the state kept per candidate.

An idempotency key belongs to an actor, not to a candidate. Keys that requests of several candidates share are settled
in rounds: whoever had the key accepted first, by ``seq``, in the last round takes it from the later ones, until nothing
changes any more; the n-th contested request is right after n rounds at the latest.

Defined cases: a request with a null actor, outcome or candidate gets the error of that field; a null key never replays;
``seq`` must be unique (of equal ones either may be first); an unknown candidate's requests are errors one by one; a
correction's new candidate can be reviewed from the next batch on.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinlode.functions.canonical import canonical
from veinlode.operators.reviews import OUTCOMES, request_hash
from veinlode.operators.tables import settled

RECORDED, REPLAY, NO_OP = "recorded", "replay", "no_op"
ANSWERS = "candidate_id string, seq long, answer string, decision_id string, previous string, outcome string, request_hash string, key string, child_id string, child_decision string"
#: What a fold needs of each request, besides the columns of requests.
_INPUT = ("candidate_id", "seq", "kind", "outcome", "actor_id", "actor_type", "reason", "expected_head", "check_head", "key", "hash", "payload", "child_name", "known", "head", "state", "leaf", "allowed", "order_error", "before", "again")


def uid(prefix: str, *parts: str | None) -> str:
    """Id from a list of strings and nulls, as ``canonical`` writes it."""
    text = json.dumps(list(parts), ensure_ascii=False, separators=(",", ":"))
    return f"{prefix}_{hashlib.sha256(text.encode()).hexdigest()[:24]}"


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@dataclass
class Chain:
    """What is known of a candidate between two requests; ``keys`` are those that its later requests may repeat."""

    head: str | None
    state: str
    leaf: bool
    keys: dict[str, str] = field(default_factory=dict)


def _text(value) -> str | None:
    return None if value is None or value != value else value


def decide(chain: Chain | None, r) -> tuple:
    """Answer to one request, as a row of ANSWERS; ``chain`` is moved on when something is recorded."""
    outcome, hash_ = _text(r.outcome), r.hash

    def answer(what: str, decision=None, previous=None, key=None, child=None, child_decision=None, as_outcome=None) -> tuple:
        return r.candidate_id, r.seq, what, decision, previous, as_outcome or outcome, hash_, key, child, child_decision

    head, expected = chain and chain.head, _text(r.expected_head)
    if r.kind == "correct":
        if chain is None or not chain.leaf:
            return answer("not_leaf")
        if expected is not None and expected != head:
            return answer("review_head_conflict")
        batch = "BATCH_" + _sha(f'["correction",{json.dumps(r.candidate_id, ensure_ascii=False)},{r.payload}]')[:24]
        child = uid("CAND", batch, r.child_name)
        made = uid("DEC", r.candidate_id, child)
        confirm = json.dumps({"actor_id": r.actor_id, "actor_type": "human", "candidate_id": child, "outcome": "confirmed", "reason": _text(r.reason)}, ensure_ascii=False, separators=(",", ":"))
        chain.head, chain.state, chain.leaf = made, "superseded", False
        own = _sha(f"[{confirm},null]")
        return answer(RECORDED, made, head, made, child, uid("DEC", child, _sha(confirm), None, own), "superseded")
    if outcome not in OUTCOMES:
        return answer("review_outcome")
    if not (_text(r.actor_id) or "").strip():
        return answer("actor_required")
    if chain is None:
        return answer("unknown_candidate")
    key = _text(r.key)
    used = _text(r.before) or (chain.keys.get(f"{r.actor_type}\0{r.actor_id}\0{key}") if key else None)
    if used is not None:
        return answer(REPLAY if used == hash_ else "idempotency_payload_conflict", key=key)
    if r.check_head and expected != head:
        return answer("review_head_conflict")
    if not chain.leaf:
        return answer("not_leaf")
    if r.actor_type == "policy" and not r.allowed:
        return answer("policy_not_allowed")
    if r.actor_type not in ("policy", "human"):
        return answer("actor_type")
    if outcome == "confirmed" and _text(r.order_error):
        return answer(r.order_error)
    if chain.state == outcome and head is not None:
        return answer(NO_OP, head)
    key = key or uid("KEY", hash_, head)
    made = uid("DEC", r.candidate_id, hash_, head, key)
    if r.again:
        chain.keys[f"{r.actor_type}\0{r.actor_id}\0{key}"] = hash_
    chain.head, chain.state = made, outcome
    return answer(RECORDED, made, head, key)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split(" ")[0] for c in ANSWERS.split(", ")], dtype=object).astype({"seq": "int64"})


def _start(r) -> Chain | None:
    return Chain(_text(r.head), _text(r.state) or "pending", bool(r.leaf)) if r.known else None


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    at, chain = None, None
    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            if at is None or r.candidate_id != at:
                at, chain = r.candidate_id, _start(r)
            out.append(decide(chain, r))
        yield _frame(out)


def _prepared(requests: DataFrame, states: DataFrame, done: DataFrame, policies: DataFrame) -> DataFrame:
    """Requests with all that their fold needs, but for keys that are used inside the batch."""
    allowed = policies.select("actor_id", "rule").distinct().withColumn("listed", F.lit(True))
    r = request_hash(requests).withColumn("payload", canonical(F.col("payload")))
    r = r.join(states.withColumn("known", F.lit(True)), "candidate_id", "left").join(allowed, ["actor_id", "rule"], "left")
    r = r.join(done.select("actor_type", "actor_id", "key", F.col("request_hash").alias("before")), ["actor_type", "actor_id", "key"], "left")
    may = F.coalesce(F.col("listed") & F.col("current_derivation"), F.lit(False))
    no = F.lit(False)
    return r.withColumns({"allowed": may, "known": F.coalesce("known", no), "leaf": F.coalesce("leaf", no), "check_head": F.coalesce("check_head", no)})


def review_in_order(requests: DataFrame, states: DataFrame, done: DataFrame, policies: DataFrame) -> DataFrame:
    """requests(candidate_id, seq, kind review or correct, outcome, actor_id, actor_type, reason, expected_head,
    check_head, key, payload as JSON, child_name) against states(candidate_id, head, state, leaf, rule,
    current_derivation, order_error) and done(actor_type, actor_id, key, request_hash): one row of ANSWERS each."""
    ready = _prepared(requests, states, done, policies)
    own = ["actor_type", "actor_id", "key"]
    uses = ready.where("key is not null and kind = 'review'").groupBy(*own).agg(F.count(F.lit(1)).alias("uses"), F.count_distinct("candidate_id").alias("candidates")).where("uses > 1")
    uses = settled(uses.withColumn("again", F.lit(True)))
    ready = settled(ready.join(uses, own, "left").withColumn("again", F.coalesce("again", F.lit(False))))
    if uses.where("candidates > 1").isEmpty():
        return _folded(ready)
    crossing = ready.where("candidates > 1").select("candidate_id", "seq", "actor_type", "actor_id", "key", "before")
    taken, last = ready.select("seq", F.lit(None).cast("string").alias("taken")).where("false"), None
    while True:
        answers = _folded(ready.join(taken, "seq", "left").withColumn("before", F.coalesce("before", "taken")))
        won = answers.where(F.col("answer") == RECORDED).join(crossing.select("seq", "actor_type", "actor_id"), "seq")
        first = won.groupBy("actor_type", "actor_id", "key").agg(F.min(F.struct("seq", "candidate_id", "request_hash")).alias("w"))
        later = crossing.join(first, own).where("w.seq < seq and w.candidate_id <> candidate_id and before is null")
        taken = settled(later.select("seq", F.col("w.request_hash").alias("taken")))
        now = taken.agg(F.count(F.lit(1)), F.sum(F.xxhash64("seq", "taken").cast("decimal(38,0)"))).first()
        if now == last:
            return answers
        last = now


def _folded(ready: DataFrame) -> DataFrame:
    rows = ready.select(*_INPUT).repartition("candidate_id").sortWithinPartitions("candidate_id", "seq")
    return rows.mapInPandas(_fold, ANSWERS)


def events(answers: DataFrame, requests: DataFrame) -> DataFrame:
    """Review events to append, corrections' children included."""
    who = requests.select("seq", "actor_id", "actor_type", "reason")
    told = answers.where(F.col("answer") == RECORDED).join(who, "seq")
    own = told.select("decision_id", "candidate_id", "outcome", "actor_type", "actor_id", "reason", "previous", "request_hash", "key", "seq")
    child = told.where("child_id is not null").select(F.col("child_decision").alias("decision_id"), F.col("child_id").alias("candidate_id"), F.lit("confirmed").alias("outcome"), F.lit("human").alias("actor_type"), "actor_id", "reason", F.lit(None).cast("string").alias("previous"), F.lit(None).cast("string").alias("request_hash"), F.lit(None).cast("string").alias("key"), "seq")
    return own.unionByName(child)


def heads(answers: DataFrame, states: DataFrame) -> DataFrame:
    """Head, state and leaf of every candidate after the batch."""
    last = answers.where(F.col("answer") == RECORDED).groupBy("candidate_id").agg(F.max_by(F.struct("decision_id", "outcome", "child_id"), "seq").alias("l"))
    out = states.select("candidate_id", "head", "state", "leaf").join(last, "candidate_id", "left")
    old = out.select("candidate_id", F.coalesce("l.decision_id", "head").alias("head"), F.coalesce("l.outcome", "state").alias("state"), (F.col("leaf") & F.col("l.child_id").isNull()).alias("leaf"))
    child = answers.where("child_id is not null").select(F.col("child_id").alias("candidate_id"), F.col("child_decision").alias("head"), F.lit("confirmed").alias("state"), F.lit(True).alias("leaf"))
    return old.unionByName(child)


def opened(answers: DataFrame, supports: DataFrame) -> DataFrame:
    """Reconciliations that the batch opens: decisions on candidates that support an object already."""
    told = answers.where(F.col("answer") == RECORDED).join(supports.select("candidate_id").distinct(), "candidate_id")
    joined = F.to_json(F.array("candidate_id", "decision_id"))
    return told.select(F.concat(F.lit("REC_"), F.substring(F.sha2(joined.cast("binary"), 256), 1, 24)).alias("reconciliation_id"), "candidate_id", "seq")


def reconcile(openings: DataFrame, closings: DataFrame) -> DataFrame:
    """Closings to append: one for every opening that has none; history stays as it is."""
    return openings.select("reconciliation_id").distinct().join(closings.select("reconciliation_id"), "reconciliation_id", "left_anti")


def review_stream(requests: DataFrame, states: DataFrame, done: DataFrame, policies: DataFrame) -> DataFrame:
    """The same fold over a stream of requests, whose keys aren't shared between candidates; the state of a candidate
    is its chain. Within a micro-batch requests are put in the order of ``seq``."""
    ready = _prepared(requests, states, done, policies).withColumn("again", F.col("key").isNotNull()).select(*_INPUT)

    def fold(_, batches: Iterator[pd.DataFrame], kept) -> Iterator[pd.DataFrame]:
        chain = None
        if kept.exists:
            head, state, leaf, keys = kept.get
            chain = Chain(head, state, leaf, json.loads(keys))
        rows = pd.concat(list(batches)).sort_values("seq")  # what one micro-batch has of one candidate
        out = []
        for r in rows.itertuples(index=False):
            chain = chain or _start(r)
            out.append(decide(chain, r))
        if chain is not None:
            kept.update((chain.head, chain.state, chain.leaf, json.dumps(chain.keys)))
        yield _frame(out)

    return ready.groupBy("candidate_id").applyInPandasWithState(fold, ANSWERS, "head string, state string, leaf boolean, keys string", "append", "NoTimeout")
