"""Per-row derivations: names, keys, places and codecs, as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from blockstrata import config as C


def hex_slice(name: Column, byte: int, length: int) -> Column:
    """``length`` bytes (7 at most) of a hexadecimal name as a number."""
    return F.conv(F.substring(name, 2 * byte + 1, 2 * length), 16, 10).cast("long")


def div(a: Column, b) -> Column:
    """Whole quotient of non-negative numbers."""
    return F.call_function("div", a, F.lit(b) if isinstance(b, int) else b)


def block_name(block: Column) -> Column:
    """A 16-byte content name as 32 hexadecimal digits."""
    return F.md5(block.cast("binary"))


def hash_zone(name: Column, zones: int) -> Column:
    return F.shiftright(hex_slice(name, 0, 1) * zones, 8)


def index_key(name: Column, lists: int = 256, address_bits: int = 20) -> tuple[Column, Column]:
    """Delta list and address of a name in the volume index: the address is the low bits of its first eight bytes, the list the rest."""
    low = hex_slice(name, 4, 4)
    rest = F.shiftleft(hex_slice(name, 0, 4), 32 - address_bits).bitwiseOR(F.shiftright(low, address_bits))
    return rest % lists, low.bitwiseAND(F.lit((1 << address_bits) - 1))


def chapter_key(name: Column, list_bits: int, address_bits: int) -> tuple[Column, Column]:
    """Delta list and address in a chapter index, from bytes 8 to 13."""
    h = hex_slice(name, 8, 6)
    return F.shiftright(h, address_bits) % (1 << list_bits), h.bitwiseAND(F.lit((1 << address_bits) - 1))


def open_slot(name: Column, slots: int) -> Column:
    return hex_slice(name, 8, 6) % slots


def sampling_bytes(name: Column) -> Column:
    return hex_slice(name, 14, 2)


def is_hook(name: Column, rate: int = C.SAMPLE_RATE) -> Column:
    return sampling_bytes(name) % rate == 0


def page_of(lbn: Column) -> Column:
    return div(lbn, C.ENTRIES_PER_PAGE)


def root_of(lbn: Column, roots: int = C.ROOTS) -> Column:
    return page_of(lbn) % roots


def logical_zone(lbn: Column, zones: int, roots: int = C.ROOTS) -> Column:
    return root_of(lbn, roots) % zones


def map_slot(lbn: Column) -> Column:
    return lbn % C.ENTRIES_PER_PAGE


def tree_path(lbn: Column, roots: int = C.ROOTS) -> list[tuple[Column, Column]]:
    """(page within its root, slot) at each height of the block map tree, leaves first."""
    index = div(page_of(lbn), roots)
    out = [(index, map_slot(lbn))]
    for _ in range(1, C.TREE_HEIGHT):
        slot, index = index % C.ENTRIES_PER_PAGE, div(index, C.ENTRIES_PER_PAGE)
        out.append((index, slot))
    return out


def slab_of(pbn: Column, first: int, shift: int) -> tuple[Column, Column]:
    """Slab and offset within it."""
    return F.shiftright(pbn - first, shift), (pbn - first).bitwiseAND(F.lit((1 << shift) - 1))


def physical_chapter(vcn: Column, chapters: int, remapped_virtual: int = 0, remapped_physical: int = 0) -> Column:
    """Where a virtual chapter is stored.

    A converted volume has lost one chapter, so it has an odd number of them; the moved
    chapter lies at ``remapped_physical`` and the others run on around it.
    """
    if chapters % 2 == 0:
        return vcn % chapters
    past, back = vcn - remapped_virtual, remapped_virtual - vcn
    after = F.when(past > remapped_physical, past % chapters).otherwise(past - 1)
    before = F.when(back < chapters, chapters - back).otherwise(F.lit(0).cast("long"))
    return F.when(past > 0, after).when(past == 0, F.lit(remapped_physical).cast("long")).otherwise(before)


def state_of_slot(slot: Column) -> Column:
    return slot + 2


def slot_of_state(state: Column) -> Column:
    return state - 2


def is_compressed(state: Column) -> Column:
    return state > 1


def pack_entry(pbn: Column, state: Column) -> Column:
    """A block map entry in one number: 36 bits of block and 4 of state."""
    return F.shiftleft(pbn.cast("long"), 4).bitwiseOR(state.cast("long"))


def unpack_entry(entry: Column) -> tuple[Column, Column]:
    return F.shiftright(entry, 4), entry.bitwiseAND(F.lit(15))


def pack_journal_entry(op: Column, slot: Column, page_pbn: Column) -> Column:
    """The first 48 bits of a recovery journal entry: 2 of operation, 10 of slot, 36 of page."""
    return F.shiftleft(page_pbn.cast("long"), 12).bitwiseOR(F.shiftleft(slot.cast("long"), 2)).bitwiseOR(op.cast("long"))


def unpack_journal_entry(entry: Column) -> tuple[Column, Column, Column]:
    return entry.bitwiseAND(F.lit(3)), F.shiftright(entry, 2).bitwiseAND(F.lit(1023)), F.shiftright(entry, 12)


def _byte(x: Column) -> Column:
    return F.lpad(F.hex(x.cast("long")), 2, "0")


def _little(x: Column, n: int) -> Column:
    """The low ``n`` bytes of a number, the lowest first, in hexadecimal."""
    return F.concat(*[_byte(F.shiftright(x.cast("long"), 8 * k).bitwiseAND(F.lit(255))) for k in range(n)])


def _of_little(text: Column, byte: int, n: int) -> Column:
    """A number of ``n`` bytes (7 at most) stored from ``byte`` on, the lowest first."""
    return F.conv(F.concat(*[F.substring(text, 2 * (byte + k) + 1, 2) for k in reversed(range(n))]), 16, 10).cast("long")


def entry_bytes(pbn: Column, state: Column) -> Column:
    """A block map entry as stored: 5 bytes, in hexadecimal. State and the high bits of the block share the first."""
    return F.concat(_byte(state.bitwiseOR(F.shiftleft(F.shiftright(pbn.cast("long"), 32).bitwiseAND(F.lit(15)), 4))), _little(pbn, 4))


def read_entry_bytes(text: Column, byte: int = 0) -> tuple[Column, Column]:
    """Block and state of a stored block map entry that begins at ``byte``."""
    first = hex_slice(text, byte, 1)
    return F.shiftleft(F.shiftright(first, 4), 32).bitwiseOR(_of_little(text, byte + 1, 4)), first.bitwiseAND(F.lit(15))


def journal_entry_bytes(op: Column, slot: Column, page_pbn: Column, pbn: Column, state: Column) -> Column:
    """A recovery journal entry as stored: 6 bytes of operation, slot and page, then the 5 of the mapping, in hexadecimal."""
    return F.concat(_little(pack_journal_entry(op, slot, F.lit(0)).bitwiseOR(F.shiftleft(F.shiftright(page_pbn.cast("long"), 32).bitwiseAND(F.lit(15)), 12)), 2), _little(page_pbn, 4), entry_bytes(pbn, state))


def read_journal_entry_bytes(text: Column) -> tuple[Column, Column, Column, Column, Column]:
    """Operation, slot, page, block and state of a stored recovery journal entry."""
    head = _of_little(text, 0, 2)
    page = F.shiftleft(F.shiftright(head, 12), 32).bitwiseOR(_of_little(text, 2, 4))
    return head.bitwiseAND(F.lit(3)), F.shiftright(head, 2).bitwiseAND(F.lit(1023)), page, *read_entry_bytes(text, 6)


def pack_slab_entry(sbn: Column, increment: Column) -> Column:
    """A slab journal entry: 23 bits of offset, 1 of direction."""
    return F.shiftleft(increment.cast("int"), 23).bitwiseOR(sbn.cast("int"))


def unpack_slab_entry(entry: Column) -> tuple[Column, Column]:
    return entry.bitwiseAND(F.lit((1 << 23) - 1)), F.shiftright(entry, 23) == 1


def slab_entry_op(increment: Column, typed: Column, types: Column, n: Column) -> Column:
    """The operation of slab journal entry ``n``: in a block with types (an array of bytes), a set bit marks a block map increment."""
    own = F.get(types, div(n, 8).cast("int")).cast("long")
    power = F.pow(F.lit(2), n % 8).cast("long")
    marked = F.coalesce(own.bitwiseAND(power) != 0, F.lit(False))
    return F.when(typed & marked, "block_map_increment").when(increment, "data_increment").otherwise("data_decrement")


def next_point(seq: Column, entry: Column, per_block: int) -> tuple[Column, Column]:
    """The journal point one entry further."""
    full = entry + 1 == per_block
    return F.when(full, seq + 1).otherwise(seq), F.when(full, F.lit(0).cast("long")).otherwise(entry + 1)


def pack_point(seq: Column, entry: Column) -> Column:
    return F.shiftleft(seq.cast("long"), 16).bitwiseOR(entry.cast("long"))


def unpack_point(point: Column) -> tuple[Column, Column]:
    return F.shiftright(point, 16), point.bitwiseAND(F.lit(65535))


def code_bits(gap: Column, mean_delta: int) -> Column:
    """Length of the code of a gap."""
    low, keys, step = C.coding_constants(mean_delta)
    return F.when(gap < keys, F.lit(low).cast("long")).otherwise(low + 1 + div(gap - keys, step))


def delta_code(gap: Column, mean_delta: int) -> Column:
    """The code of a gap as a string of bits, the lowest first: a fixed field, and for wide gaps zeros closed by a one."""
    low, keys, step = C.coding_constants(mean_delta)
    field = lambda x: F.reverse(F.lpad(F.bin(x), low, "0"))
    wide = gap - keys
    return F.when(gap < keys, field(gap)).otherwise(F.concat(field(wide % step + keys), F.repeat(F.lit("0"), div(wide, step).cast("int")), F.lit("1")))


def read_delta_code(code: Column, mean_delta: int) -> Column:
    """The gap of a code."""
    low, keys, step = C.coding_constants(mean_delta)
    value = F.conv(F.reverse(F.substring(code, 1, low)), 2, 10).cast("long")
    return F.when(value < keys, value).otherwise(value + (F.length(code) - low - 1) * step)


def reference_status(count: Column) -> Column:
    return F.when(count == 0, "free").when(count == 1, "single").when(count == C.PROVISIONAL, "provisional").otherwise("shared")


def fullness_hint(free: Column, shift: int) -> Column:
    return F.when(free == 0, F.lit(0).cast("long")).otherwise(F.greatest(F.lit(1).cast("long"), F.shiftright(free, shift)))


def free_from_hint(hint: Column, shift: int) -> Column:
    return F.shiftleft(hint, shift)


def ilog2(n: Column) -> Column:
    """Whole binary logarithm of a positive number, exact for all of them."""
    return F.length(F.bin(n)) - 1


def slab_priority(free: Column, unopened: Column, unopened_class: int) -> Column:
    """0 if full, a reserved class if never opened, else by the logarithm of the free blocks."""
    p = 1 + ilog2(free)
    return F.when(free == 0, 0).when(unopened, unopened_class).otherwise(F.when(p < unopened_class, p).otherwise(p + 1))


def pages_for(entries: Column) -> Column:
    return div(entries + (C.ENTRIES_PER_PAGE - 1), C.ENTRIES_PER_PAGE)


def forest_levels(entries: Column, roots: int = C.ROOTS) -> list[Column]:
    """Interior pages of one root at each height."""
    size = div(F.greatest(pages_for(entries), F.lit(1).cast("long")) + (roots - 1), roots)
    out = []
    for _ in range(C.TREE_HEIGHT):
        size = div(size + (C.ENTRIES_PER_PAGE - 1), C.ENTRIES_PER_PAGE)
        out.append(size)
    return out


def advice_bytes(state: Column, pbn: Column, version: int = 2) -> Column:
    """Stored advice, where content of a name was last written: a version, a state and 8 bytes of block, in hexadecimal."""
    return F.concat(_byte(F.lit(version)), _byte(state), _little(pbn, 8))


def read_advice(text: Column) -> tuple[Column, Column, Column]:
    """Version, state and block of stored advice; blocks have 36 bits."""
    return hex_slice(text, 0, 1), hex_slice(text, 1, 1), _of_little(text, 2, 7)
