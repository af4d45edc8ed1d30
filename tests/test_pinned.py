"""Values that other implementations of the formats give as well."""

import hashlib

import numpy as np

from tessella.sources import hybrid_file


def test_fixed_point_transform_of_a_unit():
    y, x = np.mgrid[0:16, 0:16]
    rgb = np.stack([(x * 17 + y * 3) & 255, (x * 5 + y * 11) & 255, (x * 13 + y * 7) & 255], axis=-1).astype(np.uint8)
    tables = hybrid_file.quality_tables(70)
    blocks = hybrid_file.quantise(hybrid_file.transformed(rgb), tables)
    pixels = hybrid_file.pixels(hybrid_file.HybridImage(16, 16, np.ones(1, dtype=np.int64), None, tables, blocks)).astype(np.uint8)
    opaque = np.concatenate([pixels, np.full((16, 16, 1), 255, dtype=np.uint8)], axis=-1)
    # SHA-256 of the coefficients as text and of the RGBA bytes.
    assert hashlib.sha256(",".join(map(str, blocks[0].ravel().tolist())).encode()).hexdigest() == "77af8a036bc17220ec891b9d0a2478e7a3d388c3b7d5937ee58491fa9bba6912"
    assert hashlib.sha256(opaque.tobytes()).hexdigest() == "d962facfc7087ffea2f14016ab68f6bff48318da2e5651f259a7efbd992b2218"
