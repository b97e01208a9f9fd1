"""Readers and writers of the vector file formats, manifests, codebooks and catalogs."""

from .catalog import load_catalog, load_config, resolve
from .files import load_vectors, read_codebook, read_manifest, write_codebook, write_manifest, write_vectors
from .segments import SegmentDataSource, read_segment, segment_codebook, write_segments
from .vecs import VecsDataSource, register

__all__ = ["SegmentDataSource", "VecsDataSource", "load_catalog", "load_config", "load_vectors", "read_codebook", "read_manifest", "read_segment", "register", "resolve", "segment_codebook", "write_codebook", "write_manifest", "write_segments", "write_vectors"]
