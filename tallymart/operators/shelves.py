"""Baskets against the prices of many shops, without listing the pairs of a basket and a shop.

Prices stand in a table of items by shops, and who sells an item in a row of bits. The shops that have all of a basket are the conjunction of its items' rows, so for most baskets
only these shops are added up. Shops that lack something are added up for a basket that too few complete shops answer; shops below their minimum are found
among those that sell one of the lines for less than the minimum. What comes out is what all pairs would give.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa

#: Cells of baskets by shops that are looked at together, as bits and as sums.
WIDE, NARROW = 1 << 21, 1 << 17
NONE = np.iinfo(np.int64).max
#: Levels of an item's prices, quantities at which sellers are told apart, shops that need no further choice. They change speed only.
LEVELS, QUANTITIES, FEW = 16, np.array([1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 256, 1024]), 64


class Shelves:
    """Who sells what at what price: `price` > 0 of `item` (a number below `items`) in the shop at place `shop` of `ids`, which ascend; each pair once. `alone`: whether an item has one seller anywhere."""

    def __init__(self, items: int, item: np.ndarray, shop: np.ndarray, price: np.ndarray, ids: np.ndarray, fee: np.ndarray, minimum: np.ndarray, alone: np.ndarray):
        self.items, self.item, self.shop, self.ids, self.fee, self.minimum, self.alone = items, item, shop, ids, fee, minimum, np.append(alone, False)
        self.price = price.astype(np.int32) if price.max(initial=0) < 1 << 31 else price
        self.places = max(1, len(ids).bit_length())  # bits of a shop's place below a total

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("prices", "sellers", "dear", "reached")}

    @cached_property
    def prices(self) -> np.ndarray:
        """Items by shops; 0 where a shop has none, and in the last row, which stands for items that nobody sells."""
        table = np.zeros((self.items + 1, len(self.ids)), self.price.dtype)
        table[self.item, self.shop] = self.price
        return table

    def _bits(self, table: np.ndarray) -> np.ndarray:
        bits = np.packbits(table, axis=1, bitorder="little")
        return np.ascontiguousarray(np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8)))).view(np.uint64)

    @cached_property
    def sellers(self) -> np.ndarray:
        """Items by words of 64 shops, least bit first."""
        return self._bits(self.prices > 0)

    @cached_property
    def dear(self) -> tuple[np.ndarray, np.ndarray]:
        """Prices of each item at LEVELS levels, the last its highest, and the bits of the sellers that ask more."""
        order = np.lexsort((self.price, self.item))
        begin = self.item[order].searchsorted(np.arange(self.items + 2))
        n = np.diff(begin)[:, None]
        at = begin[:-1, None] + -(-n * np.arange(1, LEVELS + 1) // LEVELS) - 1
        price = np.where(n > 0, self.price[order][np.clip(at, 0, len(order) - 1)], 0).astype(np.int64)
        return price, np.stack([self._bits(self.prices > price[:, k, None]) for k in range(LEVELS)], axis=1)

    @cached_property
    def reached(self) -> np.ndarray:
        """At each of QUANTITIES, the bits of the sellers whose minimum that much of the item alone reaches."""
        return np.stack([self._bits((self.prices > 0) & (self.prices >= -(-self.minimum // n))) for n in QUANTITIES], axis=1)

    def whole(self, m: np.ndarray) -> np.ndarray:
        """Bits of the shops that have all items of each row of m."""
        bits = self.sellers[m[:, 0]]
        for j in range(1, m.shape[1]):
            bits &= self.sellers[m[:, j]]
        return bits

    def some(self, m: np.ndarray, dropped: np.ndarray, level: np.ndarray) -> np.ndarray:
        """Bits of the shops that have an item of each row of m and none for which `dropped` has them at the item's level."""
        bits, out = self.sellers[m[:, 0]], dropped[m[:, 0], level[:, 0]]
        for j in range(1, m.shape[1]):
            bits |= self.sellers[m[:, j]]
            out |= dropped[m[:, j], level[:, j]]
        return bits & ~out

    def within(self, m: np.ndarray, q: np.ndarray, budget: np.ndarray) -> np.ndarray:
        """Bits of the shops that have an item of each row and sell no line of it for more than the budget, and perhaps of others."""
        price, bits = self.dear
        level = (price[m] * q[:, :, None] < budget[:, None, None]).sum(axis=2)
        return self.some(m, bits, np.minimum(level, LEVELS - 1))

    def listed(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many bits of each row are set, and the places of set bits, by row and place."""
        n, flat, width = np.bitwise_count(bits).sum(axis=1, dtype=np.int64), bits.view(np.uint8).ravel(), bits.shape[1] * 64
        at = np.flatnonzero(flat != 0)
        one = np.flatnonzero(np.unpackbits(flat[at], bitorder="little").view(bool))
        return n, (at << 3)[one >> 3] + (one & 7) - np.repeat(np.arange(len(bits)) * width, n)

    def summed(self, m: np.ndarray, q: np.ndarray, n: np.ndarray, shop: np.ndarray) -> np.ndarray:
        """Subtotals of n shops of each row."""
        flat, total = self.prices.ravel(), np.zeros(len(shop), np.int64)
        for j in range(m.shape[1]):
            total += flat[np.repeat(m[:, j] * len(self.ids), n) + shop] * np.repeat(q[:, j], n)
        return total

    def chosen(self, m: np.ndarray, q: np.ndarray, n: np.ndarray) -> np.ndarray:
        """A budget within which some of the n complete shops of each row are."""
        level = np.where(n > FEW, np.ceil((FEW / 2 / np.maximum(n, 1)) ** (1 / m.shape[1]) * LEVELS).astype(np.int64) - 1, LEVELS - 1)
        return (self.dear[0][m, level[:, None]] * q).max(axis=1)

    def least(self, m: np.ndarray, q: np.ndarray, bits: np.ndarray, whole: np.ndarray, most: int) -> np.ndarray:
        """The `most` least keys of each row among the shops in bits, ascending: two bits of class (incomplete, below the minimum), total, shop."""
        n, shop = self.listed(bits)
        total = self.summed(m, q, n, shop)
        row = np.repeat(np.arange(len(m)), n)
        key = (~whole.ravel()[row * whole.shape[1] + (shop >> 6)] >> (shop & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64) * 2 + (total < self.minimum[shop])
        key = (((key << 61 - self.places) + total + self.fee[shop]) << self.places) + shop
        out, have = np.full((len(m), most), NONE), np.flatnonzero(n)
        if len(have):
            starts = (np.cumsum(n) - n)[have]
            for rank in range(most):
                out[have, rank] = best = np.minimum.reduceat(key, starts)
                if rank + 1 < most:
                    key[key == np.repeat(best, n[have])] = NONE
        return out

    def added(self, m: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Subtotals of all shops, 0 where a shop has nothing: prices and quantities are above 0."""
        total = np.zeros((len(m), len(self.ids)), np.int64)
        term = np.empty_like(total)
        for j in range(m.shape[1]):
            np.multiply(self.prices[m[:, j]], q[:, j, None], out=term)
            total += term
        return total

    def ranked(self, m: np.ndarray, q: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, shop, rank) of the first `most` shops: complete first, then at least the minimum, then the total and the shop.

        Shops within a budget are enough if the last of them has everything and a total of at most the budget; else all complete ones are, if the last is one above its minimum. Then incomplete
        ones within another budget come in, and all shops where these don't do.
        """
        keys, whole = np.full((len(m), most), NONE), self.whole(m)
        n = np.bitwise_count(whole).sum(axis=1, dtype=np.int64)
        total = lambda key: key >> self.places & (1 << 61 - self.places) - 1
        todo = np.flatnonzero(n > FEW)
        if len(todo):
            budget = self.chosen(m[todo], q[todo], n[todo])
            keys[todo] = self.least(m[todo], q[todo], whole[todo] & self.within(m[todo], q[todo], budget), whole[todo], most)
            last = keys[todo, -1]
            todo = todo[(last >> 61 > 0) | (total(last) > budget)]
        todo = np.sort(np.append(todo, np.flatnonzero((n <= FEW) & (n >= most))))
        keys[todo] = self.least(m[todo], q[todo], whole[todo], whole[todo], most)
        few = np.flatnonzero(keys[:, -1] >> 61 > 0)
        if len(few):
            budget = np.sort(self.dear[0][m[few], LEVELS // 8 - 1] * q[few], axis=1)[:, min(1, m.shape[1] - 1)]
            keys[few] = self.least(m[few], q[few], whole[few] | self.within(m[few], q[few], budget), whole[few], most)
            last = keys[few, -1]
            few = few[(last >> 61 > 2) | (last >> 61 == 2) & (total(last) > budget)]
        step = max(1, NARROW // len(self.ids))
        for at in range(0, len(few), step):
            rows = few[at : at + step]
            keys[rows] = self.every(m[rows], q[rows], whole[rows], most)
        row, rank = np.nonzero(keys != NONE)
        return row, keys[row, rank] & (1 << self.places) - 1, rank + 1

    def every(self, m: np.ndarray, q: np.ndarray, whole: np.ndarray, most: int) -> np.ndarray:
        """As `least` among all shops."""
        total = self.added(m, q)
        key = np.where(np.unpackbits(whole.view(np.uint8), axis=1, count=len(self.ids), bitorder="little"), 0, 2) + (total < self.minimum)
        key = (((key << 61 - self.places) + total + self.fee) << self.places) + np.arange(len(self.ids))
        key[total == 0] = NONE
        out = np.empty((len(m), most), np.int64)
        for rank in range(most):
            out[:, rank] = key.min(axis=1)
            key[key == out[:, rank, None]] = NONE
        return out

    def cheapest(self, m: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, shop, total, shop, subtotal) of the least total and the least subtotal among shops that have everything and whose minimum is met."""
        whole = self.whole(m)
        n = np.bitwise_count(whole).sum(axis=1, dtype=np.int64)
        least, mask = np.full((len(m), 2), NONE), (1 << self.places) - 1

        def look(rows: np.ndarray, bits: np.ndarray) -> None:
            n, shop = self.listed(bits)
            total = self.summed(m[rows], q[rows], n, shop)
            low, have = total < self.minimum[shop], np.flatnonzero(n)
            if len(have):
                for k, fee in enumerate((self.fee[shop], 0)):
                    key = ((total + fee) << self.places) + shop
                    key[low] = NONE
                    least[rows[have], k] = np.minimum.reduceat(key, (np.cumsum(n) - n)[have])

        todo = np.flatnonzero(n > FEW)
        if len(todo):  # shops beyond the budget have a subtotal above it
            budget = self.chosen(m[todo], q[todo], n[todo])
            look(todo, whole[todo] & self.within(m[todo], q[todo], budget))
            todo = todo[least[todo, 0] >> self.places > budget]
        todo = np.append(todo, np.flatnonzero((n <= FEW) & (n > 0)))
        look(todo, whole[todo])
        row = np.flatnonzero(least[:, 0] != NONE)
        return row, least[row, 0] & mask, least[row, 0] >> self.places, least[row, 1] & mask, least[row, 1] >> self.places

    def below(self, m: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, shops below their minimum, shops that have everything) of the rows that some shop has something of. A shop that one line alone lifts to its minimum isn't looked at."""
        complete = np.bitwise_count(self.whole(m)).sum(axis=1, dtype=np.int64)
        n, shop = self.listed(self.some(m, self.reached, QUANTITIES.searchsorted(q, side="right") - 1))
        row = np.repeat(np.arange(len(m)), n)[self.summed(m, q, n, shop) < self.minimum[shop]]
        have = np.flatnonzero(self.sellers.any(axis=1)[m].any(axis=1))
        return have, np.bincount(row, minlength=len(m))[have], complete[have]


def contents(begin: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
    """Of lists that begin at `begin` (with the end as last) the number of the run of equal lists next to each other that each is in, from 0."""
    size = np.diff(begin)
    same = np.append(False, size[1:] == size[:-1]) if len(size) else np.zeros(0, bool)
    back = np.repeat(np.where(same, size, 0), size)
    at = np.arange(len(back)) - back  # the same place of the list before
    differs = np.logical_or.reduce([c != c[at] for c in columns])
    bad = np.append(0, np.cumsum(differs))
    same &= bad[begin[1:]] == bad[begin[:-1]]
    return np.cumsum(~same) - 1


def ranking(shelves: Shelves, most: int) -> Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, dict]]:
    """Makes columns of the first `most` shops of each row of items, quantities and units."""

    def columns(m: np.ndarray, q: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, dict]:
        row, shop, rank = shelves.ranked(m, q, most)
        price = shelves.prices[m[row], shop[:, None]].astype(np.int64)
        sold, wanted_units = price > 0, (q * u).sum(axis=1)[row]
        subtotal, units = (price * q[row]).sum(axis=1), (sold * q[row] * u[row]).sum(axis=1)
        return row, {
            "shop_id": shelves.ids[shop], "found": sold.sum(axis=1), "wanted": np.full(len(row), m.shape[1]), "units": units, "wanted_units": wanted_units, "subtotal": subtotal, "fee": shelves.fee[shop],
            "required": (sold & shelves.alone[m[row]]).any(axis=1), "complete": units == wanted_units, "enough": subtotal >= shelves.minimum[shop], "total": subtotal + shelves.fee[shop], "rank": rank,
        }

    return columns


def cheapest(shelves: Shelves) -> Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, dict]]:
    """Makes columns of the least total and the least subtotal of the shops that answer a row whole."""

    def columns(m: np.ndarray, q: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, dict]:
        row, shop, total, other, subtotal = shelves.cheapest(m, q)
        return row, {"t": pa.StructArray.from_arrays([total, shelves.ids[shop]], ["total", "shop_id"]), "s": pa.StructArray.from_arrays([subtotal, shelves.ids[other]], ["subtotal", "shop_id"])}

    return columns


def below(shelves: Shelves) -> Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, dict]]:
    """Makes columns of how many shops are below their minimum and how many have everything."""

    def columns(m: np.ndarray, q: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, dict]:
        row, n, complete = shelves.below(m, q)
        return row, {"below_minimum": n, "complete": complete}

    return columns


def answered(shared, make: Callable[[Shelves], Callable], names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For batches of (basket_id, lines of item, quantity, units): the columns that `make` gives for each; lists that are equal and next to each other are met once. `shared` has the Shelves as its value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, shops = make(shared.value), max(1, len(shared.value.ids))
        for batch in batches:
            lists = batch.column("lines")
            size = np.asarray(lists.value_lengths()).astype(np.int64)
            flat = [np.asarray(c).astype(np.int64) for c in lists.flatten().flatten()]
            begin = np.append(0, np.cumsum(size))
            run_of = contents(begin, flat)
            heads = np.flatnonzero(np.diff(run_of, prepend=-1))
            members = np.diff(heads, append=len(run_of))
            for k in np.unique(size[heads]):
                alike, step = np.flatnonzero(size[heads] == k), max(1, WIDE // shops)
                for at in range(0, len(alike), step):
                    some = alike[at : at + step]
                    place = begin[heads[some]][:, None] + np.arange(k)
                    row, out = columns(*(c[place] for c in flat))
                    n = members[some][row]
                    each = np.repeat(np.arange(len(row)), n)
                    basket = np.repeat(heads[some][row] - np.cumsum(n) + n, n) + np.arange(len(each))
                    yield pa.RecordBatch.from_arrays([batch.column("basket_id").take(pa.array(basket)), *((out[c] if isinstance(out[c], pa.Array) else pa.array(out[c])).take(pa.array(each)) for c in names)], ["basket_id", *names])

    return run
