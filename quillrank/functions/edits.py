"""Edit distance with adjacent swaps, and the keys that make it an equi-join.

Two words within the allowed number of edits always share at least one key, so
joining on the key and verifying the distance finds exactly the pairs that a
comparison of everything with everything would find.

Keys are 64-bit hashes; two different keys with one hash only add a candidate
that the verification drops.

* Indexed words of up to ``DELETE_LENGTH`` characters have as keys the word with up to
  ``d`` characters left out, whose number grows with the square of the length.
* Up to ``HALF_LENGTH`` characters they are cut in two halves. Two edits spoil one of
  them at most once, a swap across the cut being one edit in each, so the keys are each
  half and what is left of it after leaving out one character.
* Longer words are cut into ``2 * d + 1`` pieces: an edit spoils at most two pieces, so
  one survives unchanged within ``d`` positions of where it was.
* Words of digits alone are cut in halves from ``NUMBER_LENGTH`` characters on. Tables have about as
  many numbers as rows, of which queries name few, so few keys a number count for more than few
  candidates; of each length there are only so many numbers.

Query words look under the keys of all lengths that are near enough.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillrank.functions.lets import let

MAX_EDITS = 2
DELETE_LENGTH = 9
NUMBER_LENGTH = 6
HALF_LENGTH = 20
PIECES = 2 * MAX_EDITS + 1


def allowed_edits(word: Column) -> Column:
    """0, 1 or 2 edits for up to 2, 3 to 5, and more than 5 characters."""
    size = F.length(word)
    return F.when(size <= 2, 0).when(size <= 5, 1).otherwise(MAX_EDITS)


def _no_keys() -> Column:
    return F.array().cast("array<bigint>")


def _no_digits(word: Column) -> Column:
    """How many characters of ``word`` are no digits."""
    return F.length(F.call_function("translate", word, F.lit("0123456789"), F.lit("")))


def _numbers(first: Column, last: Column) -> Column:
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def _without(word: Column, place: Column) -> Column:
    return F.concat(
        F.substring(word, F.lit(1), place - 1), F.substring(word, place + 1, F.length(word))
    )


def _delete_keys(word: Column, depth: Column) -> Column:
    """The word and what is left of it after leaving out up to ``depth`` characters."""
    size = F.length(word)

    def from_place(place: Column) -> Column:
        return let(_without(word, place), lambda shorter: F.concat(
            F.array(F.xxhash64(shorter)),
            F.when(depth >= 2, F.transform(
                _numbers(place, size - 1), lambda second: F.xxhash64(_without(shorter, second))
            )).otherwise(_no_keys()),
        ))

    fewer = F.flatten(F.transform(_numbers(F.lit(1), size), from_place))
    return F.concat(F.array(F.xxhash64(word)), F.when(depth >= 1, fewer).otherwise(_no_keys()))


def _half_key(side: int, size: Column, text: Column) -> Column:
    return F.xxhash64(F.lit(side), size, text)


def _half_less_one(side: int, size: Column, text: Column) -> Column:
    return F.transform(_numbers(F.lit(1), F.length(text)), lambda place: _half_key(side, size, _without(text, place)))


def _cut(size: Column) -> Column:
    """Length of the first half."""
    return F.floor(size / 2).cast("int")


def _half_keys(word: Column) -> Column:
    def keys(side: int, half: Column) -> Column:
        return let(half, lambda text: F.concat(
            F.array(_half_key(side, F.length(text), text)), _half_less_one(side, F.length(text), text)))

    first = _cut(F.length(word))
    return F.concat(keys(0, F.substring(word, F.lit(1), first)), keys(1, F.substring(word, first + 1, F.length(word))))


def _fewest_halved(word: Column) -> Column:
    """Length of the shortest words cut in halves that can be near ``word``; one with more other characters is near no number."""
    return F.when(_no_digits(word) <= MAX_EDITS, NUMBER_LENGTH).otherwise(DELETE_LENGTH + 1)


def _half_probe_keys(word: Column) -> Column:
    own = F.length(word)

    def part(side: int, length: Column) -> Column:
        return F.substring(word, F.lit(1) if side == 0 else own - length + 1, length)

    def of_half(side: int, size: Column) -> Column:
        same = part(side, size)
        return F.concat(
            F.array(_half_key(side, size, same), _half_key(side, size, part(side, size - 1))),
            _half_less_one(side, size, same), _half_less_one(side, size, part(side, size + 1)),
        )

    sizes = _numbers(F.greatest(own - MAX_EDITS, _fewest_halved(word)), F.least(own + MAX_EDITS, F.lit(HALF_LENGTH)))
    return F.flatten(F.transform(sizes, lambda size: F.concat(
        of_half(0, _cut(size)), of_half(1, size - _cut(size)))))


def _piece_start(size: Column, piece: Column) -> Column:
    return F.floor(size * piece / F.lit(PIECES)).cast("int") + 1


def _piece_key(size: Column, piece: Column, text: Column) -> Column:
    return F.xxhash64(size, piece, text)


def _pieces() -> Column:
    return F.sequence(F.lit(0), F.lit(PIECES - 1))


def _piece_keys(word: Column) -> Column:
    size = F.length(word)
    return F.transform(_pieces(), lambda piece: _piece_key(
        size, piece,
        F.substring(word, _piece_start(size, piece),
                    _piece_start(size, piece + 1) - _piece_start(size, piece)),
    ))


def _piece_probe_keys(word: Column) -> Column:
    own = F.length(word)

    def at(size: Column, piece: Column, shift: Column) -> Column:
        start = _piece_start(size, piece)
        width = _piece_start(size, piece + 1) - start
        return F.when(
            (start + shift >= 1) & (start + shift + width - 1 <= own),
            _piece_key(size, piece, F.substring(word, start + shift, width)),
        )

    shifts = F.sequence(F.lit(-MAX_EDITS), F.lit(MAX_EDITS))
    keys = F.flatten(F.flatten(F.transform(
        _numbers(F.greatest(own - MAX_EDITS, F.lit(HALF_LENGTH + 1)), own + MAX_EDITS),
        lambda size: F.transform(_pieces(), lambda piece: F.transform(
            shifts, lambda shift: at(size, piece, shift))),
    )))
    return F.filter(keys, lambda k: k.isNotNull())


def probe_keys(word: Column) -> Column:
    """Keys under which a query word looks for its neighbours."""
    size = F.length(word)
    return F.array_distinct(F.concat(
        F.when(size <= DELETE_LENGTH + MAX_EDITS, _delete_keys(word, allowed_edits(word))).otherwise(_no_keys()),
        F.when(size.between(_fewest_halved(word) - MAX_EDITS, F.lit(HALF_LENGTH + MAX_EDITS)), _half_probe_keys(word)).otherwise(_no_keys()),
        F.when(size > HALF_LENGTH - MAX_EDITS, _piece_probe_keys(word)).otherwise(_no_keys()),
    ))


def _in_halves(word: Column) -> Column:
    number = (F.length(word) >= NUMBER_LENGTH) & (_no_digits(word) == 0)
    return (F.length(word) <= HALF_LENGTH) & ((F.length(word) > DELETE_LENGTH) | number)


def vocabulary_keys(word: Column) -> Column:
    """Keys under which an indexed word can be found."""
    size = F.length(word)
    depth = F.when(size <= 1, 0).when(size <= 3, 1).otherwise(MAX_EDITS)
    return F.array_distinct(F.when(_in_halves(word), _half_keys(word)).when(
        size <= DELETE_LENGTH, _delete_keys(word, depth)).otherwise(_piece_keys(word)))


def most_keys(word: Column) -> Column:
    """An upper bound of the number of keys of an indexed word."""
    size = F.length(word).cast("bigint")
    return F.when(_in_halves(word), size + 2).when(
        size <= DELETE_LENGTH, 1 + size * (size + 1) / 2).otherwise(PIECES).cast("bigint")


def _swaps(word: Column) -> Column:
    return F.transform(
        _numbers(F.lit(1), F.length(word) - 1),
        lambda i: F.concat(
            F.substring(word, F.lit(1), i - 1),
            F.substring(word, i + 1, F.lit(1)),
            F.substring(word, i, F.lit(1)),
            F.substring(word, i + 2, F.length(word)),
        ),
    )


def _foreign(word: Column, other: Column) -> Column:
    """How many characters of ``word`` do not occur in ``other`` at all."""
    return F.length(F.call_function("translate", word, other, F.lit("")))


def may_be_near(left: Column, right: Column, allowed: Column) -> Column:
    """False only for words that are more than ``allowed`` edits apart; cheaper than the distance.

    Beyond ``allowed`` plain edits a swap must save some. It is two plain edits, changes no
    length and brings no new character, so only the other edits can do that.
    """
    others = allowed - 1
    difference = F.abs(F.length(left) - F.length(right))
    by_swaps = (difference <= others) & (_foreign(left, right) <= others) & (_foreign(right, left) <= others)
    return (difference <= allowed) & F.when(
        by_swaps, F.levenshtein(left, right, 2 * MAX_EDITS) >= 0
    ).otherwise(F.levenshtein(left, right, MAX_EDITS) >= 0)


def edits_within_two(left: Column, right: Column) -> Column:
    """Edit distance counting an adjacent swap as one edit; 3 means more than two.

    A swap is two plain edits, so the plain distance decides most pairs: 0 and 1
    are final, 2 can only become 1 by a single swap, and above 4 nothing helps.
    What is left needs a swap and at most one other edit. Such a script can start
    with the swap on one of the two words, so trying each swap first on either
    side covers all of them.
    """
    beyond = F.lit(MAX_EDITS + 1)
    same_length = F.length(left) == F.length(right)

    def near(swapped: Column, other: Column) -> Column:
        return F.exists(swapped, lambda s: F.levenshtein(s, other, 1) >= 0)

    def swap_and_one_more(both: Column) -> Column:
        return near(both["l"], right) | near(both["r"], left) | F.arrays_overlap(both["l"], both["r"])

    possible = (
        (F.abs(F.length(left) - F.length(right)) <= 1)
        & (_foreign(left, right) <= 1) & (_foreign(right, left) <= 1)
    )
    pair = F.struct(_swaps(left).alias("l"), _swaps(right).alias("r"))
    return let(F.levenshtein(left, right, 2 * MAX_EDITS), lambda plain: (
        F.when(plain < 0, beyond)
        .when(plain <= 1, plain)
        .when(plain == 2, F.when(same_length & F.array_contains(_swaps(left), right), 1).otherwise(2))
        .when(possible, F.when(let(pair, swap_and_one_more), 2).otherwise(beyond))
        .otherwise(beyond)
    ))
