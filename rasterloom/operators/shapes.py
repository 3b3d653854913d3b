"""Rectangles and squares of one colour, and packing of rectangles: sequential by image or atlas, parallel across them."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Side beyond which an atlas is too large.
MOST_SIDE = 1 << 17


class AreaTooLarge(ValueError):
    """The rectangles do not fit into the largest atlas."""


def _dense(pdf):
    """Values as whole codes in a (h, w) array; a missing pixel is like no other."""
    import numpy as np

    x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
    image = -1 - np.arange((y.max() + 1) * (x.max() + 1), dtype=np.int64).reshape(y.max() + 1, x.max() + 1)
    codes, values = pdf["v"].factorize()
    image[y, x] = codes
    return image, values


def rectangle_sizes(image):
    """Width of the equal run to the left, and height of the stack of runs at least as wide above, at each pixel."""
    import numpy as np

    h, w = image.shape
    wide, high = np.ones((h, w), dtype=np.int64), np.ones((h, w), dtype=np.int64)
    for i in range(1, w):
        wide[:, i] = np.where(image[:, i] == image[:, i - 1], wide[:, i - 1] + 1, 1)
    for j in range(1, h):
        on = (image[j] == image[j - 1]) & (wide[j - 1] >= wide[j])
        high[j] = np.where(on, high[j - 1] + 1, 1)
    return wide, high


def square_sizes(image):
    """Side of the largest square of one colour that ends at each pixel, as its three neighbours tell."""
    import numpy as np

    h, w = image.shape
    side = np.ones((h, w), dtype=np.int64)
    for j in range(1, h):
        same = (image[j, 1:] == image[j, :-1]) & (image[j, 1:] == image[j - 1, 1:]) & (image[j, 1:] == image[j - 1, :-1])
        for i in (np.flatnonzero(same) + 1).tolist():
            side[j, i] = 1 + min(side[j, i - 1], side[j - 1, i], side[j - 1, i - 1])
    return side, side


def collect(wide, high, apart: bool = False):
    """Greedy choice from the bottom right: what is taken is no other's corner; apart: and one that reaches into it is cut back to what is free."""
    import numpy as np

    out = []
    h, w = wide.shape
    free = np.ones((h, w), dtype=bool)
    for j in range(h - 1, -1, -1):
        for i in range(w - 1, -1, -1):
            if not free[j, i]:
                continue
            a, b = int(wide[j, i]), int(high[j, i])
            held = free[j - b + 1 : j + 1, i - a + 1 : i + 1]
            if apart and not held.all():
                # the free run that ends here, and the rows from here up that are free over it
                a = int(np.argmin(np.append(held[-1, ::-1], False)))
                b = int(np.argmin(np.append(held[::-1, -a:].all(axis=1), False)))
            x, y = i - a + 1, j - b + 1
            free[y : j + 1, x : i + 1] = False
            out.append((x, y, i, j, i, j))
    return out


def _find(px: DataFrame, sizes, keep=None, apart: bool = False) -> DataFrame:
    kind = px.schema["v"].dataType.simpleString()
    key = px.schema["image_id"].dataType.simpleString()

    def find(key, pdf):
        import pandas as pd

        image, values = _dense(pdf)
        rows = [(key[0], n, x0, y0, x1, y1, values[image[j, i]]) for n, (x0, y0, x1, y1, i, j) in enumerate(collect(*sizes(image), apart)) if image[j, i] >= 0]
        return pd.DataFrame(rows, columns=["image_id", "seq", "x0", "y0", "x1", "y1", "v"])

    out = px.groupBy("image_id").applyInPandas(find, f"image_id {key}, seq int, x0 int, y0 int, x1 int, y1 int, v {kind}")
    return out if keep is None else out.filter(keep)


def find_rectangles(px: DataFrame, keep=None, apart: bool = False) -> DataFrame:
    """(image_id, seq, x0, y0, x1, y1, v): closed rectangles of one value, found from the bottom right; keep: a condition on v.

    As in the reference, one may reach into another of its value that was found before; apart: it ends there, so they tile the image.
    """
    return _find(px, rectangle_sizes, keep, apart)


def find_squares(px: DataFrame, keep=None) -> DataFrame:
    return _find(px, square_sizes, keep)


#: Free areas that are looked through one by one; of so many, the greatest height is known.
_BLOCK = 64


class _Free:
    """The free areas of an atlas in the order in which they are tried, each [x, y, w, h, block, whether it is as wide as the rectangle at hand].

    Blocks of up to _BLOCK neighbours know the greatest height of their areas that are wide enough. An area that is not
    waits until a narrower rectangle comes; rectangles come by falling width, so this happens once to each.
    """

    def __init__(self, width: int, height: int):
        import numpy as np

        self.blocks: list[list] = [[[], 0]]  # areas, place
        self.tall = np.full(64, -1, dtype=np.int64)
        self.waiting: list[tuple] = []
        self.width, self.made = None, 0
        self.put(self.blocks[0], 0, 0, [(0, 0, width, height)])

    def narrow(self, width: int) -> None:
        """From now on areas of this width are wide enough."""
        import heapq

        if self.width is not None and width > self.width:
            held = [r for block in self.blocks for r in block[0]]
            self.waiting = [(-r[2], k, r) for k, r in enumerate(held)]
            heapq.heapify(self.waiting)
            self.made = len(held)
            self.tall[:] = -1
            for r in held:
                r[5] = False
        self.width = width
        while self.waiting and -self.waiting[0][0] >= width:
            r = heapq.heappop(self.waiting)[2]
            if r[4] is not None:
                r[5] = True
                self.tall[r[4][1]] = max(self.tall[r[4][1]], r[3])

    def first(self, height: int):
        """(block, place in it) of the first area that is wide and high enough, or None."""
        enough = self.tall >= height
        at = int(enough.argmax())
        if not enough[at]:
            return None
        block = self.blocks[at]
        return block, next(i for i, r in enumerate(block[0]) if r[5] and r[3] >= height)

    def put(self, block: list, at: int, gone: int, areas: list[tuple[int, int, int, int]]) -> None:
        """`areas` in place of the `gone` ones at a place of a block."""
        import heapq

        import numpy as np

        new = [[*r, block, self.width is not None and r[2] >= self.width] for r in areas]
        for r in block[0][at : at + gone]:
            r[4] = None
        block[0][at : at + gone] = new
        for r in new:
            if not r[5]:
                self.made += 1
                heapq.heappush(self.waiting, (-r[2], self.made, r))
        changed = [block]
        if len(block[0]) > _BLOCK:
            more = [block[0][_BLOCK // 2 :], 0]
            del block[0][_BLOCK // 2 :]
            for r in more[0]:
                r[4] = more
            self.blocks.insert(block[1] + 1, more)
            for k in range(block[1] + 1, len(self.blocks)):
                self.blocks[k][1] = k
            if len(self.blocks) > len(self.tall):
                self.tall = np.append(self.tall, np.full(len(self.tall), -1, dtype=np.int64))
            self.tall[more[1] + 1 :] = self.tall[more[1] : -1].copy()
            changed.append(more)
        for b in changed:
            self.tall[b[1]] = max((r[3] for r in b[0] if r[5]), default=-1)


def try_pack(sizes: list[tuple[int, int]], width: int, height: int, partly: bool = False) -> list[tuple[int, int] | None] | None:
    """Places of rectangles in order, or None: each takes the corner of the first free area that holds it.

    Taking a corner leaves the strip below (as wide as the rectangle) and all to its right, in this order and in place of
    the area. Areas in which none of the rectangles that follow has room are forgotten. partly: one that fits nowhere has
    no place (None), and the others go on.
    """
    import numpy as np

    if not sizes:
        return []
    least = np.minimum.accumulate(np.array(sizes, dtype=np.int64)[::-1], axis=0)[::-1].tolist()[1:] + [[MOST_SIDE + 1] * 2]
    free = _Free(width, height)
    places: list[tuple[int, int] | None] = []
    for (w, h), (least_w, least_h) in zip(sizes, least, strict=True):
        if w != free.width:
            free.narrow(w)
        found = free.first(h)
        if found is None:
            if not partly:
                return None
            places.append(None)
            continue
        block, at = found
        x, y, aw, ah = block[0][at][:4]
        places.append((x, y))
        left = ((x, y + h, w, ah - h), (x + w, y, aw - w, ah))
        inside = (h < ah, w < aw)
        free.put(block, at, 1, [r for r, own in zip(left, inside, strict=True) if own and r[2] >= least_w and r[3] >= least_h])
    return places


def pack_sizes(sizes: list[tuple[int, int]], inflate: float = 2.0, most: tuple[int, int] | None = None) -> tuple[list[tuple[int, int]], int, int]:
    """Places and atlas size: from 64 x 64, the shorter side grows until all fit."""
    w = h = 64

    def grow():
        nonlocal w, h
        if most and (w, h) == tuple(most):
            raise AreaTooLarge(f"more than {most} is needed")
        if w <= h and (not most or w < most[0]):
            w = min(int(w * inflate), most[0]) if most else int(w * inflate)
        else:
            h = min(int(h * inflate), most[1]) if most else int(h * inflate)
        if max(w, h) > MOST_SIDE:
            raise AreaTooLarge(f"{w} x {h}")

    total = sum(a * b for a, b in sizes)
    while w * h < total:
        grow()
    while (places := try_pack(sizes, w, h)) is None:
        grow()
    return places, w, h


def pack_sheets(sizes: list[tuple[int, int]], inflate: float = 2.0, most: tuple[int, int] | None = None) -> list[tuple[int, int, int, int, int]]:
    """(sheet, x, y, w, h) of each rectangle: as pack_sizes while the largest atlas holds them all, else in several sheets.

    A sheet of the largest size takes what it can, in order; the rest goes to the next. Only a rectangle that is itself
    larger than a sheet raises AreaTooLarge.
    """
    out: list = [None] * len(sizes)
    rest, sheet = list(range(len(sizes))), 0
    while rest:
        own = [sizes[k] for k in rest]
        try:
            places, w, h = pack_sizes(own, inflate, most)
        except AreaTooLarge:
            w, h = most or (MOST_SIDE, MOST_SIDE)
            if any(a > w or b > h for a, b in own):
                raise
            places = try_pack(own, w, h, partly=True)
        for k, p in zip(rest, places, strict=True):
            if p is not None:
                out[k] = (sheet, *p, w, h)
        rest, sheet = [k for k, p in zip(rest, places, strict=True) if p is None], sheet + 1
    return out


def pack(rects: DataFrame, inflate: float = 2.0, most: tuple[int, int] | None = None) -> DataFrame:
    """rects (atlas_id, rect_id, w, h) with pack_x, pack_y, atlas_w, atlas_h and sheet; wider ones first, ties by rect_id.

    An atlas whose rectangles the largest size does not hold has several sheets, from 0, see pack_sheets.
    """

    def run(pdf):
        pdf = pdf.sort_values(["w", "rect_id"], ascending=[False, True], kind="stable")
        return pdf.assign(**_placed(pack_sheets(list(zip(pdf["w"].tolist(), pdf["h"].tolist(), strict=True)), inflate, most)))[["atlas_id", "rect_id", "w", "h", "pack_x", "pack_y", "atlas_w", "atlas_h", "sheet"]]

    kind = lambda c: rects.schema[c].dataType.simpleString()
    return rects.select("atlas_id", "rect_id", "w", "h").groupBy("atlas_id").applyInPandas(run, f"atlas_id {kind('atlas_id')}, rect_id {kind('rect_id')}, w {kind('w')}, h {kind('h')}, pack_x int, pack_y int, atlas_w int, atlas_h int, sheet int")


def _placed(places: list[tuple[int, int, int, int, int]]) -> dict:
    import numpy as np

    return dict(zip(("sheet", "pack_x", "pack_y", "atlas_w", "atlas_h"), np.array(places, dtype=np.int32).reshape(-1, 5).T, strict=True))


def merge_rects(rects: DataFrame) -> DataFrame:
    """Greedy union of bounds (atlas_id, rect_id, x0, y0, x1, y1) while it saves area; a merged one keeps the least id."""

    def run(pdf):
        import pandas as pd

        live = [list(r) for r in pdf.sort_values("rect_id")[["rect_id", "x0", "y0", "x1", "y1"]].itertuples(index=False)]
        area = lambda r: (r[3] - r[1]) * (r[4] - r[2])
        again = True
        while again:
            again = False
            for i in range(len(live)):
                for j in range(len(live) - 1, i, -1):
                    a, b = live[i], live[j]
                    both = [a[0], min(a[1], b[1]), min(a[2], b[2]), max(a[3], b[3]), max(a[4], b[4])]
                    if area(both) < area(a) + area(b):
                        live[i], again = both, True
                        del live[j]
        out = pd.DataFrame(live, columns=["rect_id", "x0", "y0", "x1", "y1"])
        out.insert(0, "atlas_id", pdf["atlas_id"].iloc[0])
        return out

    return rects.select("atlas_id", "rect_id", "x0", "y0", "x1", "y1").groupBy("atlas_id").applyInPandas(run, rects.select("atlas_id", "rect_id", "x0", "y0", "x1", "y1").schema)
