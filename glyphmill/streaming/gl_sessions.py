"""Captured graphics calls as a stream: the counters of `operators.gl_calls` with state in Spark's state store.

Calls of a session may arrive in any order, within a micro-batch and over several: a call waits until those before it (seq counts from 1)
are there. Each `frame` call emits the frame's counters with what lives at its end. A session that is idle for a while emits its totals and
leaves the store; calls that still wait are then taken in order, over the gaps.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from glyphmill.operators.gl_calls import BLENDS, DRAW_ARRAYS, DRAW_ELEMENTS, ONE, SRC_ALPHA, UNPACK_PREMULTIPLY, UPLOADS

COUNTERS = ("draws", "binds", "redundant", "uploads", "compiles")
_CALL = "seq long, call string, target string, object string, level long, w long, h long, bytes long, value long"
#: Running numbers of a session: the next call, frames, counters of the frame and of all, and what lives: textures, pixels plain and with mipmaps, compressed bytes.
_NUMBERS = ("next", "frames", *COUNTERS, *(f"all_{c}" for c in COUNTERS), "textures", "pixels", "mip_pixels", "compressed", "premultiplied", "straight", "unpack_premultiply")


def output_schema(session: str) -> str:
    return f"session {session}, seq long, final boolean, " + ", ".join(f"{c} long" for c in COUNTERS) + ", live_textures long, vram long, compressed long, premultiplied boolean, straight boolean, unpack_premultiply boolean"


class GlSession(StatefulProcessor):
    """One session's calls in order. State: numbers, bound texture of each target, live textures with their levels, waiting calls."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.numbers = handle.getValueState("numbers", ", ".join(f"{n} long" for n in _NUMBERS) + ", bound string, used boolean, program string")
        self.targets = handle.getMapState("targets", "target string", "object string")
        self.textures = handle.getMapState("textures", "texture string", "w long, h long, mipmapped boolean, levels array<long>, bytes array<long>")
        self.waiting = handle.getMapState("waiting", "seq long", _CALL)

    # ------------------------------------------------------------ one call

    def _texture(self, name: str | None) -> list | None:
        if name is None:
            return None
        if name not in self.held:
            self.held[name] = None
            if self.textures.containsKey((name,)):
                w, h, mip, levels, size = self.textures.getValue((name,))
                self.held[name] = [w, h, mip, dict(zip(levels, size, strict=True))]
        return self.held[name]

    def _count(self, t: list, sign: int) -> None:
        """Add a texture to what lives, or take it away."""
        size = sum(t[3].values())
        self.n["compressed"] += sign * size
        if not size:
            self.n["mip_pixels" if t[2] else "pixels"] += sign * t[0] * t[1]

    def _change(self, name: str | None, to: list | None) -> None:
        old = self._texture(name)
        if old is not None:
            self._count(old, -1)
            self.n["textures"] -= 1
        if to is not None:
            self._count(to, 1)
            self.n["textures"] += 1
        self.held[name] = to
        self.changed.add(name)

    def _bind(self, kind: str, same: bool) -> None:
        self.n["binds" if kind == "texture" else "_"] += 1
        self.n["redundant"] += same

    def _apply(self, c: tuple) -> tuple | None:
        """Take one call; the row of a frame that it ends."""
        _, call, target, obj, level, w, h, size, value = c
        n = self.n
        n["draws"] += call in DRAW_ELEMENTS or call in DRAW_ARRAYS
        n["uploads"] += call in UPLOADS
        n["compiles"] += call == "compileShader"
        if call == "bindTexture":
            key = target or ""
            if key not in self.bound:
                self.bound[key] = self.targets.getValue((key,)) if self.targets.containsKey((key,)) else None
            self._bind("texture", self.bound[key] is not None and self.bound[key][0] == obj)
            self.bound[key] = (obj,)
            n["bound"] = obj
        elif call == "useProgram":
            self._bind("program", bool(n["used"]) and n["program"] == obj)
            n["used"], n["program"] = True, obj
        elif call == "createTexture" and obj is not None:
            self._change(obj, [0, 0, False, {}])
        elif call == "deleteTexture" and obj is not None:
            self._change(obj, None)
        elif call in ("texImage2D", "compressedTexImage2D", "generateMipmap") and (t := self._texture(n["bound"])) is not None:
            new = [t[0], t[1], t[2] or call == "generateMipmap", dict(t[3])]
            if call == "compressedTexImage2D":
                if level == 0:
                    new[3].clear()
                new[3][level] = size
            if call != "generateMipmap" and level == 0 and w > 0 and h > 0:
                new[0], new[1] = w, h
            self._change(n["bound"], new)
        elif call in BLENDS:
            n["premultiplied"] |= value == ONE
            n["straight"] |= value == SRC_ALPHA
        elif call == "pixelStorei":
            n["unpack_premultiply"] |= value == UNPACK_PREMULTIPLY and level != 0
        elif call == "frame":
            n["frames"] += 1
            for name in COUNTERS:
                n[f"all_{name}"] += n[name]
            row = self._row(False, "")
            n.update(dict.fromkeys(COUNTERS, 0))
            return row
        return None

    def _row(self, final: bool, of: str) -> tuple:
        n = self.n
        vram = (3 * (4 * n["pixels"] + n["compressed"]) + 16 * n["mip_pixels"] + 1) // 3  # thirds, rounded
        return (n["frames"], final, *(n[f"{of}{c}"] for c in COUNTERS), n["textures"], vram, n["compressed"], bool(n["premultiplied"]), bool(n["straight"]), bool(n["unpack_premultiply"]))

    # ------------------------------------------------------------ state

    def _load(self) -> None:
        self.held: dict = {}
        self.changed: set = set()
        self.bound: dict = {}
        names = (*_NUMBERS, "bound", "used", "program")
        self.n = dict(zip(names, self.numbers.get(), strict=True)) if self.numbers.exists() else {**dict.fromkeys(_NUMBERS, 0), "next": 1, "bound": None, "used": False, "program": None}
        self.n["_"] = 0

    def _store(self) -> None:
        self.numbers.update(tuple(self.n[k] for k in (*_NUMBERS, "bound", "used", "program")))
        for name in self.changed:
            t = self.held[name]
            if t is not None:
                self.textures.updateValue((name,), (t[0], t[1], t[2], list(t[3]), list(t[3].values())))
            elif self.textures.containsKey((name,)):
                self.textures.removeKey((name,))
        for target, was in self.bound.items():
            if was is not None:
                self.targets.updateValue((target,), was)

    def _frame(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in rows], columns=["session", "seq", "final", *COUNTERS, "live_textures", "vram", "compressed", "premultiplied", "straight", "unpack_premultiply"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self._load()
        fresh: dict[int, tuple] = {}
        for pdf in rows:
            for r in zip(*(pdf[c].tolist() for c in ("seq", "call", "target", "object", "level", "w", "h", "bytes", "value")), strict=True):
                clean = [None if isinstance(x, float) and x != x else x for x in r]
                fresh[int(clean[0])] = (int(clean[0]), *clean[1:4], *(int(x or 0) for x in clean[4:]))
        out = []
        while True:
            seq = self.n["next"]
            if seq in fresh:
                call = fresh.pop(seq)
            elif self.waiting.containsKey((seq,)):
                call = self.waiting.getValue((seq,))
                self.waiting.removeKey((seq,))
            else:
                break
            row = self._apply(call)
            out += [row] if row else []
            self.n["next"] = seq + 1
        for seq, call in fresh.items():
            if seq > self.n["next"]:  # what came before is a repeat
                self.waiting.updateValue((seq,), call)
        self._store()
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        if out:
            yield self._frame(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._load()
        out = [row for _, call in sorted((k[0], v) for k, v in self.waiting.iterator()) if (row := self._apply(call))]
        for name in COUNTERS:
            self.n[f"all_{name}"] += self.n[name]
        out.append(self._row(True, "all_"))
        for state in (self.numbers, self.targets, self.textures, self.waiting):
            state.clear()
        yield self._frame(key, out)

    def close(self) -> None:
        pass


def gl_sessions(calls: DataFrame, idle_ms: int = 600_000) -> DataFrame:
    """calls: a stream as in `operators.gl_calls`. A row for each frame that ends, and one with the totals (final) for each session that is idle that long.

    Needs the state store on RocksDB (spark.sql.streaming.stateStore.providerClass). A session's state is its live textures, its targets, waiting
    calls and some numbers, however long it runs.
    """
    kind = calls.schema["session"].dataType.simpleString()
    return calls.groupBy("session").transformWithStateInPandas(GlSession(idle_ms), output_schema(kind), "append", "processingTime")
