"""Column functions: sizes, names, checksums and Bloom arithmetic."""

from .bloom import bloom_bits_of, bloom_params, md5_bits_of
from .sizes import entry_bytes, memtable_bytes, record_bytes
from .text import file_name, iso_utc, record_crc

__all__ = ["bloom_bits_of", "bloom_params", "entry_bytes", "file_name", "iso_utc", "md5_bits_of", "memtable_bytes", "record_bytes", "record_crc"]
