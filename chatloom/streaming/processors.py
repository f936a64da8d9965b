"""Stateful per-chat processors with bounded state.

They need the RocksDB state store:
``spark.sql.streaming.stateStore.providerClass`` =
``org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import fixed

GROUP_SCHEMA = "chat_key string, group_no long, range_from long, range_to long"
REVISION_SCHEMA = "chat_key string, n long, op string, group_no long, version long, range_from long, range_to long"
STATE_SCHEMA = "chat_key string, subject string, attribute string, value string, scope string, op string, n long"
CHECKPOINT_SCHEMA = "chat_key string, checkpoint_no long, to long, covered long"


def _frame(rows: list, columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=columns)


class L1Groups(StatefulProcessor):
    """Emit a group once ``size`` stable messages exist beyond the buffer.

    State: the positions not grouped yet (fewer than size + buffer + 1), the number of
    groups so far and where the last one ends. The newest reply that is not the user's
    waits. Edits and swipes replace their open position, deletes take it away. Changes
    inside closed groups emit nothing here: the message store retracts those.
    """

    def __init__(self, size: int = fixed.L1_GROUP_SIZE, buffer: int = fixed.STABILITY_BUFFER):
        self.size, self.buffer = size, buffer

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getListState("open", "idx long, is_user boolean")
        self.done = handle.getValueState("done", "n long, end long")

    def handleInputRows(self, key, rows, timerValues):
        n, end = self.done.get() if self.done.exists() else (0, -1)
        part = pd.concat(list(rows)).sort_values(["idx", "seq"], kind="stable").drop_duplicates("idx", keep="last")
        part = part[part["idx"] > end]
        live = ~part["is_system"].fillna(False).astype(bool) & (part["text"].fillna("").str.strip() != "") & (part["op"] != "delete")
        waiting = {r[0]: r[1] for r in self.open.get()} if self.open.exists() else {}
        for i in part.loc[~live, "idx"]:
            waiting.pop(int(i), None)
        waiting |= dict(zip(part.loc[live, "idx"].astype("int64").tolist(), part.loc[live, "is_user"].astype(bool).tolist(), strict=True))
        waiting = sorted(waiting.items())
        held = 0 if not waiting or waiting[-1][1] else 1
        stable = len(waiting) - self.buffer - held
        out, at = [], 0
        while at + self.size <= stable:
            out.append((key[0], n, int(waiting[at][0]), int(waiting[at + self.size - 1][0])))
            n, at = n + 1, at + self.size
            end = int(waiting[at - 1][0])
        self.done.update((n, end))
        self.open.put([(int(i), bool(u)) for i, u in waiting[at:]])
        yield _frame(out, ["chat_key", "group_no", "range_from", "range_to"])

    def close(self) -> None:
        pass


class _Groups:
    """Versions and positions by group number, over a map state with ``BLOCK`` groups in a value.

    Blocks are read when they are asked for, and written when ``HELD`` others came after
    them or at ``flush``: a call to the state store serves a block, not a group.
    """

    BLOCK = 256
    HELD = 32
    SCHEMA = "no array<long>, version array<long>, stands array<boolean>, idx array<long>, is_user array<boolean>"

    def __init__(self, state, size: int):
        self.state, self.size = state, size
        self.held: dict[int, dict[int, list]] = {}  # block -> group number -> [version, rows or None]
        self.changed: set[int] = set()

    def _block(self, b: int) -> dict[int, list]:
        block = self.held.pop(b, None)
        if block is None:
            if len(self.held) >= self.HELD:
                self._write(next(iter(self.held)))
            block = {}
            if self.state.containsKey((b,)):
                numbers, versions, stands, idx, users = self.state.getValue((b,))
                rows = iter(zip((int(i) for i in idx), (bool(u) for u in users), strict=True))
                block = {int(k): [int(v), [next(rows) for _ in range(self.size)] if s else None] for k, v, s in zip(numbers, versions, stands, strict=True)}
        self.held[b] = block
        return block

    def _write(self, b: int) -> None:
        block = self.held.pop(b)
        if b in self.changed:
            self.changed.discard(b)
            rows = [r for _, group in block.values() for r in group or ()]
            self.state.updateValue((b,), (list(block), [v for v, _ in block.values()], [g is not None for _, g in block.values()],
                                          [i for i, _ in rows], [u for _, u in rows]))

    def rows(self, k: int) -> list[tuple[int, bool]]:
        return self._block(k // self.BLOCK)[k][1]

    def version(self, k: int) -> int:
        known = self._block(k // self.BLOCK).get(k)
        return known[0] if known else -1

    def put(self, k: int, version: int, rows: list[tuple[int, bool]] | None) -> None:
        self._block(k // self.BLOCK)[k] = [version, rows]
        self.changed.add(k // self.BLOCK)

    def flush(self) -> None:
        for b in list(self.held):
            self._write(b)


class RevisedGroups(StatefulProcessor):
    """Level-1 groups that are withdrawn and sent again when a message inside them changes.

    State: each closed group with its positions and version, many groups in one value, the open positions, and
    counts. An edit inside a closed group retracts it and inserts its next version. A
    message that goes away, or comes in late, shifts all groups behind it: they are read
    and written one after the other, with fewer than one group of positions in hand and a
    bounded number of blocks, and
    only those that come out different are retracted and inserted. Groups that the rest
    of the chat no longer makes stable go back to the open positions.

    Output rows carry a running number per chat: the last one of a group number tells
    whether it stands (``insert``) or not, so their sum equals the batch groups.
    """

    def __init__(self, size: int = fixed.L1_GROUP_SIZE, buffer: int = fixed.STABILITY_BUFFER):
        self.size, self.buffer = size, buffer

    def init(self, handle: StatefulProcessorHandle) -> None:
        #: versions stay when a group is withdrawn, so a number never comes twice with one version
        self.blocks = handle.getMapState("groups", "block long", _Groups.SCHEMA)
        self.open = handle.getListState("open", "idx long, is_user boolean")
        self.done = handle.getValueState("done", "groups long, rows long")

    def _group(self, k: int) -> list[tuple[int, bool]]:
        return self.known.rows(k)

    def _holder(self, idx: int, groups: int) -> int:
        """The last group that starts at or before ``idx``, the first one if none does."""
        low, high = 0, groups - 1
        while low < high:
            mid = (low + high + 1) // 2
            if self._group(mid)[0][0] <= idx:
                low = mid
            else:
                high = mid - 1
        return low

    def _tell(self, op: str, k: int, rows: list[tuple[int, bool]]) -> None:
        version = self.known.version(k)
        if op == "insert":
            version += 1
            self.known.put(k, version, rows)
        self.out.append((op, k, version, rows[0][0], rows[-1][0]))

    def _close(self, k: int) -> None:
        """The group stands no longer, its version stays."""
        self.known.put(k, self.known.version(k), None)

    def handleInputRows(self, key, rows, timerValues):
        self.out: list[tuple] = []
        self.known = _Groups(self.blocks, self.size)
        groups, sent = (int(v) for v in self.done.get()) if self.done.exists() else (0, 0)
        part = pd.concat(list(rows)).sort_values(["idx", "seq"], kind="stable").drop_duplicates("idx", keep="last")
        live = ~part["is_system"].fillna(False).astype(bool) & (part["text"].fillna("").str.strip() != "") & (part["op"] != "delete")
        waiting = {int(r[0]): bool(r[1]) for r in self.open.get()} if self.open.exists() else {}
        end = self._group(groups - 1)[-1][0] if groups else -1
        edited: set[int] = set()
        moved: dict[int, dict[int, bool | None]] = {}  # group -> position -> user's, or None where it goes
        for i, ok, user in zip(part["idx"].astype("int64").tolist(), live.tolist(), part["is_user"].fillna(False).astype(bool).tolist(), strict=True):
            if i > end:
                waiting.pop(i, None)
                if ok:
                    waiting[i] = user
                continue
            k = self._holder(i, groups)
            old = dict(self._group(k))
            known = i in old
            if known and ok:
                edited.add(k)
            if known != ok or (known and old[i] != user):
                moved.setdefault(k, {})[i] = user if ok else None
        if moved:
            groups = self._shift(min(moved), groups, moved, edited, waiting)
        else:
            for k in sorted(edited):
                self._tell("retract", k, self._group(k))
                self._tell("insert", k, self._group(k))
        groups, left = self._settle(groups, waiting)
        self.known.flush()
        self.done.update((groups, sent + len(self.out)))
        # the store takes no empty list
        self.open.put(left) if left else self.open.clear()
        yield _frame([(key[0], sent + n, *row) for n, row in enumerate(self.out)], [c.split()[0] for c in REVISION_SCHEMA.split(", ")])

    def _shift(self, first: int, groups: int, moved: dict, edited: set[int], waiting: dict[int, bool]) -> int:
        """Groups from ``first`` on over again; what is left over opens again. Returns how many stand."""
        for k in sorted(k for k in edited if k < first):
            self._tell("retract", k, self._group(k))
            self._tell("insert", k, self._group(k))
        hand: list[tuple[int, bool]] = []
        at = first
        for k in range(first, groups):
            old = self._group(k)
            now = dict(old) | moved.get(k, {})
            hand += sorted((i, u) for i, u in now.items() if u is not None)
            self._close(k)
            new = []
            while len(hand) >= self.size and at + len(new) <= k:
                new.append(hand[: self.size])
                hand = hand[self.size :]
            if new and at == k and new[0] == old and k not in edited:
                self.known.put(k, self.known.version(k), old)
            else:
                self._tell("retract", k, old)
                for n, group in enumerate(new):
                    self._tell("insert", at + n, group)
            at += len(new)
        waiting |= dict(hand)
        return at

    def _settle(self, groups: int, waiting: dict[int, bool]) -> tuple[int, list[tuple[int, bool]]]:
        """Close what is stable, open what no longer is. Returns how many groups stand and the open rows."""
        rows, at = sorted(waiting.items()), 0
        while True:
            held = 0 if at == len(rows) or rows[-1][1] else 1
            stable = len(rows) - at - self.buffer - held
            if stable < 0 and groups:
                groups -= 1
                last = self._group(groups)
                self._tell("retract", groups, last)
                self._close(groups)
                rows, at = sorted(last + rows[at:]), 0
            elif stable >= self.size:
                self._tell("insert", groups, rows[at : at + self.size])
                groups, at = groups + 1, at + self.size
            else:
                return groups, rows[at:]

    def close(self) -> None:
        pass


class StateTimeline(StatefulProcessor):
    """Latest state per subject and attribute; scene rows end when a newer range arrives.

    Input: chat_key, subject, attribute, value, scope, operation, range_to, seq.
    Rows of a chat come in range order. Output rows: ``set`` or ``end``.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.live = handle.getMapState("live", "subject string, attribute string", "value string, scope string, range_to long, seq long")
        #: identities with a live scene row, all of the newest range
        self.scenes = handle.getListState("scenes", "subject string, attribute string")
        self.newest = handle.getValueState("newest", "range_to long, n long")

    def handleInputRows(self, key, rows, timerValues):
        batch = pd.concat(list(rows)).sort_values(["range_to", "seq"])
        batch = batch[batch["range_to"].notna()]
        out, chat = [], key[0]
        newest, n = self.newest.get() if self.newest.exists() else (-1, 0)
        scenes = dict.fromkeys(tuple(k) for k in self.scenes.get()) if self.scenes.exists() else {}
        now, stored = {}, {}  # rows of the identities this batch meets: each is read and written once

        def row(k):
            if k not in now:
                now[k] = stored[k] = tuple(self.live.getValue(k)) if self.live.containsKey(k) else None
            return now[k]

        columns = [batch[c].tolist() for c in ("subject", "attribute", "value", "scope", "operation", "range_to", "seq")]
        for subject, attribute, value, scope, operation, range_to, seq in zip(*columns, strict=True):
            if range_to > newest:
                for k in scenes:
                    v = row(k)
                    now[k] = None
                    out.append((chat, k[0], k[1], v[0], v[1], "end"))
                scenes.clear()
                newest = int(range_to)
            k = (subject.strip().lower(), attribute.strip().lower())
            v = row(k)
            if v is not None and v[2] > range_to:
                continue  # a late row of an older range changes nothing
            if operation == "clear":
                if v is not None:
                    now[k] = None
                    scenes.pop(k, None)
                    out.append((chat, k[0], k[1], v[0], v[1], "end"))
            elif str(value or "").strip() and (scope == "ongoing" or range_to >= newest):
                now[k] = (value, scope, int(range_to), int(seq))
                scenes.pop(k, None)
                if scope == "scene":
                    scenes[k] = None
                out.append((chat, k[0], k[1], value, scope, "set"))
        for k, v in now.items():
            if v is None and stored[k] is not None:
                self.live.removeKey(k)
            elif v != stored[k]:
                self.live.updateValue(k, v)
        # the store takes no empty list
        self.scenes.put(list(scenes)) if scenes else self.scenes.clear()
        self.newest.update((newest, n + len(out)))
        numbered = [(*row, n + i) for i, row in enumerate(out)]
        yield _frame(numbered, ["chat_key", "subject", "attribute", "value", "scope", "op", "n"])

    def close(self) -> None:
        pass


class Checkpoints(StatefulProcessor):
    """Checkpoint each ``interval`` covered messages; the first and the newest stay.

    Input: chat_key, to, covered (messages newly covered by a story update).
    """

    def __init__(self, interval: int = fixed.CHECKPOINT_INTERVAL, keep: int = fixed.CHECKPOINT_KEEP):
        self.interval, self.keep = interval, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", "no long, to long, covered long")
        self.since = handle.getValueState("since", "total long, base long, n long")

    def handleInputRows(self, key, rows, timerValues):
        batch = pd.concat(list(rows)).sort_values("to")
        total, base, n = self.since.get() if self.since.exists() else (0, 0, 0)
        kept = [tuple(r) for r in self.kept.get()] if self.kept.exists() else []
        out = []
        for r in batch.itertuples():
            total += int(r.covered)
            if total - base >= self.interval:
                kept.append((n, int(r.to), total))
                out.append((key[0], n, int(r.to), total))
                base, n = total, n + 1
        if len(kept) > self.keep:
            kept = [kept[0], *kept[-(self.keep - 1):]]
        self.since.update((total, base, n))
        self.kept.put(kept)
        yield _frame(out, ["chat_key", "checkpoint_no", "to", "covered"])

    def close(self) -> None:
        pass


def _run(df: DataFrame, processor: StatefulProcessor, schema: str) -> DataFrame:
    return df.groupBy("chat_key").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="None")


def stream_l1_groups(messages: DataFrame, size: int = fixed.L1_GROUP_SIZE, buffer: int = fixed.STABILITY_BUFFER) -> DataFrame:
    """Closed groups of a message stream with edits and deletes (I2); equals the batch groups."""
    return _run(messages.select("chat_key", "idx", "text", "is_user", "is_system", "op", "seq"), L1Groups(size, buffer), GROUP_SCHEMA)


def stream_revised_groups(messages: DataFrame, size: int = fixed.L1_GROUP_SIZE, buffer: int = fixed.STABILITY_BUFFER) -> DataFrame:
    """Groups of a message stream as inserted and retracted versions (I3): equals the batch groups after any change."""
    return _run(messages.select("chat_key", "idx", "text", "is_user", "is_system", "op", "seq"), RevisedGroups(size, buffer), REVISION_SCHEMA)


def standing_groups(revisions: DataFrame) -> DataFrame:
    """``(chat_key, group_no, version, range_from, range_to)`` that the revisions leave."""
    last = revisions.groupBy("chat_key", "group_no").agg(F.max_by(F.struct("op", "version", "range_from", "range_to"), "n").alias("r"))
    return last.filter("r.op = 'insert'").select("chat_key", "group_no", "r.version", "r.range_from", "r.range_to")


def stream_state_timeline(states: DataFrame) -> DataFrame:
    """State changes per chat (I4)."""
    cols = ["chat_key", "subject", "attribute", "value", "scope", "operation", "range_to", "seq"]
    return _run(states.select(*cols), StateTimeline(), STATE_SCHEMA)


def stream_checkpoints(updates: DataFrame, interval: int = fixed.CHECKPOINT_INTERVAL, keep: int = fixed.CHECKPOINT_KEEP) -> DataFrame:
    """Story checkpoints per chat."""
    return _run(updates.select("chat_key", "to", "covered"), Checkpoints(interval, keep), CHECKPOINT_SCHEMA)
