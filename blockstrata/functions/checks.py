"""Predicates over blocks, entries and pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from blockstrata import config as C


def is_zero_block(block: Column) -> Column:
    """A binary block of zero bytes only."""
    return F.length(F.replace(F.hex(block), F.lit("0"))) == 0


def is_blank(text: Column) -> Column:
    """The text form of a zero block: spaces only."""
    return F.trim(text) == ""


def is_mapped(state: Column) -> Column:
    return state != 0


def valid_location(pbn: Column, state: Column) -> Column:
    """The zero block is never compressed; anything else must be mapped."""
    return F.when(pbn == C.ZERO_PBN, ~(state > 1)).otherwise(is_mapped(state))


def is_data_block(pbn: Column, first: int, last: int, shift: int, data_blocks: int) -> Column:
    """The zero block, or a block in the data area of a slab."""
    return (pbn == C.ZERO_PBN) | ((pbn >= first) & (pbn < last) & ((pbn - first).bitwiseAND(F.lit((1 << shift) - 1)) < data_blocks))


def valid_journal_entry(slot: Column, page_pbn: Column, op: Column, pbn: Column, state: Column, last: int, is_data: Column) -> Column:
    """Slot and page in range and a valid mapping to a data block; tree increments are neither compressed nor zero."""
    base = (slot >= 0) & (slot < C.ENTRIES_PER_PAGE) & (page_pbn >= 0) & (page_pbn < last) & valid_location(pbn, state) & is_data
    return base & ((op != "block_map_increment") | ((pbn != C.ZERO_PBN) & (state <= 1)))


def congruent_block(sequence: Column, nonce: Column, kind: Column, place: Column, own_nonce: int, own_kind: int, size: int) -> Column:
    """A journal block that was written where it stands, by this volume."""
    return (nonce == own_nonce) & (kind == own_kind) & (sequence % size == place)


def valid_sector(check: Column, recoveries: Column, own_check: Column, own_recoveries: Column) -> Column:
    return (check == own_check) & (recoveries == own_recoveries)


def valid_advice(version: Column, state: Column, pbn: Column, first: int, last: int) -> Column:
    return (version == 2) & is_mapped(state) & (pbn != C.ZERO_PBN) & (pbn >= first) & (pbn < last)


def compressible(size: Column) -> Column:
    return size < C.FRAGMENT_AREA


def may_compress(allocated: Column, fua: Column, enabled: Column, locked: Column, discard_blocks: Column) -> Column:
    return allocated & ~fua & enabled & locked & (discard_blocks <= 1)


def may_pack(size: Column, enabled: Column, canceled: Column) -> Column:
    """Whether a block may go to the packer: it compresses enough, compression is on and not cancelled for it."""
    return compressible(size) & enabled & ~canceled


def is_sparse(vcn: Column, oldest: Column, newest: Column, dense: int, chapters: int) -> Column:
    """A chapter beyond the dense part of the window."""
    return F.lit(dense < chapters) & (newest - oldest + 1 > dense) & (vcn + dense <= newest)


def expired(vcn: Column, newest: Column, chapters: int) -> Column:
    return vcn + chapters <= newest


def chapters_to_expire(newest: Column, chapters: int, remapped_virtual: int = 0, remapped_physical: int = 0) -> Column:
    """Chapters that expire when ``newest`` opens: one, but two or none around a moved chapter."""
    oldest = newest - chapters
    moved = F.lit(remapped_physical > 0)
    around = F.when(moved & (oldest == remapped_virtual), 2).when(moved & (oldest == remapped_virtual + remapped_physical), 0).otherwise(1)
    return F.when(newest < chapters, 0).otherwise(around)


def skip_sparse(dead: Column, vcn: Column, oldest: Column, misses: Column, hook_chapter: Column | None = None, limit: int = 20_000) -> Column:
    """Whether a search passes a cached chapter by: unused or expired; not the one a hook was found in, or without a hook one of too many misses."""
    tired = misses >= limit
    other = tired if hook_chapter is None else F.when(hook_chapter.isNotNull(), vcn != hook_chapter).otherwise(tired)
    return dead | (vcn < oldest) | other


def page_validity(magic: Column, nonce: Column, pbn: Column, own_nonce: int, own_pbn: Column, own_magic: int = 1) -> Column:
    return F.when((magic != own_magic) | (nonce != own_nonce), "invalid").when(pbn == own_pbn, "valid").otherwise("bad")
