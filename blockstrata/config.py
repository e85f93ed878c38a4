"""Fixed values of the data model, configuration and its validation."""

from __future__ import annotations

from dataclasses import dataclass, field

# Fixed values of the on-disk formats and limits.
BLOCK_BYTES = 4096
ZERO_PBN = 0
MAX_REFS = 254
PROVISIONAL = 255
ENTRIES_PER_PAGE = 812
TREE_HEIGHT = 5
ROOTS = 60
COUNTS_PER_BLOCK = 4032
SLOTS = 14
FRAGMENT_AREA = 4060
MAX_FRAGMENT = 4059
PACKER_BINS = 16
JOURNAL_ENTRIES_PER_BLOCK = 311
JOURNAL_ENTRIES_PER_SECTOR = 46
SLAB_JOURNAL_FULL_ENTRIES = 1299
MAX_REQUESTS = 2048
MAX_DISCARDS = 1536
RELEASE_BATCH = 128
ALLOCATIONS_PER_ZONE = 128
SAMPLE_RATE = 32
TIMEOUT_MS = 5000
INDEX_PAGE_BYTES = 32768
RECORD_BYTES = 32
CHAPTERS_PER_GB = 1024
MAX_LOGICAL_BLOCKS = 1 << 40
MAX_PHYSICAL_BLOCKS = 1 << 36
NAME_SEED = 0x62EA60BE


class ConfigError(ValueError):
    """A configuration that breaks a rule."""


@dataclass(frozen=True)
class VolumeConfig:
    """Sizes of a volume, in blocks."""

    logical_blocks: int
    physical_blocks: int
    slab_size: int = 32768
    slab_journal_blocks: int = 224
    recovery_journal_blocks: int = 32768

    def validate(self, grown_from: VolumeConfig | None = None) -> VolumeConfig:
        """Check powers of two, bounds and that nothing shrinks."""
        power = lambda n: n > 0 and n & (n - 1) == 0
        rules = (
            (power(self.slab_size), "slab size must be a power of two"),
            (self.slab_size <= 1 << 23, "slab size is at most 2^23 blocks"),
            (self.slab_journal_blocks >= 2, "a slab journal has two blocks at least"),
            (self.slab_journal_blocks <= self.slab_size, "a slab journal fits in its slab"),
            (self.recovery_journal_blocks > 0 and power(self.recovery_journal_blocks), "recovery journal blocks must be a power of two"),
            (0 < self.physical_blocks <= MAX_PHYSICAL_BLOCKS, "physical blocks out of range"),
            (0 < self.logical_blocks <= MAX_LOGICAL_BLOCKS, "logical blocks out of range"),
        )
        for ok, said in rules:
            if not ok:
                raise ConfigError(said)
        if grown_from and (self.logical_blocks < grown_from.logical_blocks or self.physical_blocks < grown_from.physical_blocks):
            raise ConfigError("a volume can only grow")
        if grown_from and grown_from.physical_blocks < self.physical_blocks < grown_from.physical_blocks + self.slab_size:
            raise ConfigError("physical growth is one slab at least")
        return self


@dataclass(frozen=True)
class DeviceConfig:
    """What a device's configuration line says."""

    version: int
    device: str
    physical_blocks: int
    deduplication: bool = True
    compression: bool = False
    max_discard: int = 1
    threads: dict = field(default_factory=dict)


def parse_device_line(line: str) -> DeviceConfig:
    """Parse ``V4 device blocks logical_block_size cache_blocks era [key value ...]``; V0 to V3 lack the version word's keys."""
    words = line.split()
    if not words:
        raise ConfigError("an empty configuration line")
    version = int(words[0][1:]) if words[0][:1] == "V" and words[0][1:].isdigit() else 0
    if version > 4:
        raise ConfigError(f"unknown version {version}")
    rest = words[1:] if words[0][:1] == "V" else words
    if len(rest) < 2 or not rest[1].isdigit():
        raise ConfigError("a device and its size in blocks are needed")
    keys = rest[5:] if version >= 4 else []
    if len(keys) % 2:
        raise ConfigError("options come as keys with values")
    given = dict(zip(keys[::2], keys[1::2], strict=True))
    out: dict = {"version": version, "device": rest[0], "physical_blocks": int(rest[1]), "threads": {}}
    for k, v in given.items():
        if k in ("deduplication", "compression"):
            if v not in ("on", "off"):
                raise ConfigError(f"{k} is on or off")
            out[k] = v == "on"
        elif k == "maxDiscard":
            if not v.isdigit() or int(v) < 1:
                raise ConfigError("maxDiscard is a positive number")
            out["max_discard"] = int(v)
        elif k in ("ack", "bio", "bioRotationInterval", "cpu", "hash", "logical", "physical"):
            if not v.isdigit():
                raise ConfigError(f"{k} is a number")
            out["threads"][k] = int(v)
        else:
            raise ConfigError(f"unknown option {k}")
    counted = [out["threads"].get(k, 0) for k in ("hash", "logical", "physical")]
    if any(counted) and not all(counted):
        raise ConfigError("hash, logical and physical zones are all given or none")
    return DeviceConfig(**out)


def bits(n: int) -> int:
    """Bits to hold values up to n."""
    return n.bit_length()


def coding_constants(mean_delta: int) -> tuple[int, int, int]:
    """min_bits, min_keys, incr_keys of the code for gaps with this mean (ln 2 as 836158 / 1206321)."""
    incr = (836158 * mean_delta + 603160) // 1206321
    low = bits(incr + 1)
    return low, (1 << low) - incr, incr


def index_geometry(record_pages: int, chapters: int, sparse_chapters: int = 0, page_bytes: int = INDEX_PAGE_BYTES) -> dict:
    """Sizes that follow from four parameters of an index volume."""
    per_page = page_bytes // RECORD_BYTES
    per_chapter = per_page * record_pages
    list_bits = bits((per_chapter - 1) | 63) - 6
    lists, payload = 1 << list_bits, bits(record_pages - 1)
    low, _, _ = coding_constants(1 << 16)
    index_bits = per_chapter * (payload + low + 1) + per_chapter // 2
    usable = (page_bytes - 20) * 8 - (19 + index_bits // lists)
    pages = -(-(index_bits + lists * 19) // usable)
    return {
        "records_per_page": per_page, "records_per_chapter": per_chapter, "records_per_volume": per_chapter * chapters, "dense_chapters": chapters - sparse_chapters,
        "payload_bits": payload, "delta_list_bits": list_bits, "delta_lists": lists, "address_bits": 16 - list_bits + bits(per_chapter - 1),
        "index_pages": pages, "pages_per_chapter": pages + record_pages, "bytes_per_volume": page_bytes * ((pages + record_pages) * chapters + 1),
    }


def memory_sizes(memory_gb: float, sparse: bool = False, reduced: bool = False) -> tuple[int, int, int]:
    """chapters, record pages a chapter and sparse chapters for a memory size (0.25, 0.5, 0.75 or whole GB)."""
    quarters = round(memory_gb * 4)
    if memory_gb * 4 != quarters or quarters < 1 or quarters > 3 and quarters % 4:
        raise ConfigError("memory is 0.25, 0.5, 0.75 or whole GB")
    base = CHAPTERS_PER_GB * max(1, quarters // 4)
    pages = 64 * min(quarters, 4)
    sparse_chapters = 19 * base // 2 if sparse else 0
    return (10 * base if sparse else base) - reduced, pages, sparse_chapters


def slab_geometry(slab_size: int, journal_blocks: int) -> dict:
    """Blocks and journal thresholds of a slab."""
    if journal_blocks >= slab_size:
        raise ConfigError("a slab journal fits in its slab")
    refs = -(-(slab_size - journal_blocks) // COUNTS_PER_BLOCK)
    data = slab_size - refs - journal_blocks
    if data <= 0:
        raise ConfigError("no room for data in a slab")
    if slab_size < 1024:
        data = 1 << (data.bit_length() - 1)
    flush = (journal_blocks * 3 + 3) // 4
    block = flush + (journal_blocks - flush) * 5 // 7
    extra = 1 + MAX_REQUESTS // SLAB_JOURNAL_FULL_ENTRIES
    scrub = journal_blocks - extra if journal_blocks > extra else block
    return {"data_blocks": data, "reference_blocks": refs, "flushing": flush, "blocking": min(block, scrub), "scrubbing": scrub}
