"""Windows of sessions for validation, chosen on the calendar."""

from __future__ import annotations

from bisect import bisect_left


def choose_windows(days: list[str], anchors: tuple[str, ...], taken: tuple[str, str], length: int) -> list[dict]:
    """For each anchor the first run of ``length`` sessions on or after it that shares no day with another or with ``taken``.

    ``days`` is the calendar in order, a row a day. The session before a window
    is its signal, so a window never begins on the first day. An anchor that
    finds no room has no window.
    """
    used = set(range(bisect_left(days, taken[0]), bisect_left(days, taken[1] + "~")))
    out = []
    for anchor in anchors:
        start = max(1, bisect_left(days, anchor))
        while start + length <= len(days):
            clash = [i for i in range(start, start + length) if i in used]
            if not clash:
                used.update(range(start, start + length))
                out.append({"anchor": anchor, "days": days[start : start + length], "before": days[start - 1]})
                break
            start = clash[-1] + 1
    return out
