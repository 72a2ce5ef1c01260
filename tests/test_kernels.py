import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lamina.functions import boards as B
from lamina.functions import kernels as K
from lamina.functions import spans as L
from lamina.operators.clean import join_entangled
from lamina.operators.graph import assign
from lamina.operators.postproc import Repair, absorbed, eccentricity, harmonize_window, repair_slice
from lamina.operators.resample import phase_shift, shift_image
from lamina.sources import codecs

from . import pixels


def flood(mask, steps):
    out, n = np.zeros(mask.shape, int), 0
    for y, x in np.argwhere(mask):
        if out[y, x]:
            continue
        n += 1
        stack = [(y, x)]
        out[y, x] = n
        while stack:
            a, b = stack.pop()
            for dy, dx in steps:
                c, d = a + dy, b + dx
                if 0 <= c < mask.shape[0] and 0 <= d < mask.shape[1] and mask[c, d] and not out[c, d]:
                    out[c, d] = n
                    stack.append((c, d))
    return out


masks = st.integers(0, 2**32).map(lambda s: np.random.default_rng(s).random((1 + s % 9, 1 + s % 11)) < 0.3 + (s % 5) / 10)


@settings(max_examples=150, deadline=None)
@given(masks)
def test_regions_match_flood_fill(mask):
    assert (K.regions(mask, 1) == flood(mask, K.FOUR)).all()
    assert (K.regions(mask, 2) == flood(mask, K.EIGHT)).all()


@settings(max_examples=60, deadline=None)
@given(masks)
def test_runs_round_trip(mask):
    image = mask * (1 + np.arange(mask.shape[1]) // 3)
    y, a, b, v = K.runs(image)
    assert (K.paint(image.shape, y, a, b, v) == image).all()


def test_diagonal_bars():
    image = np.array([[1, 1, 0, 0], [0, 0, 1, 1]], bool)
    assert K.regions(image, 1).max() == 2 and K.regions(image, 2).max() == 1


def test_fill_holes_through_a_diagonal_leak():
    ring = np.array([[0, 1, 1, 1, 0], [0, 1, 0, 1, 0], [0, 1, 1, 0, 0]], bool)
    assert K.fill_holes(ring, 1)[1, 2] and not K.fill_holes(ring, 2)[1, 2]


def test_morphology_and_shape():
    square = np.zeros((9, 9), bool)
    square[2:7, 2:7] = True
    assert K.solidity(square) == 1.0 and K.eccentricity(square) == 0.0 and K.box_of(square) == (2, 2, 7, 7)
    gap = square.copy()
    gap[4, 4] = False
    assert K.close(gap, 1)[4, 4] and K.drop_small(square, 26).sum() == 0
    bar = np.ones((1, 9), bool)
    assert K.eccentricity(bar) == 1.0
    u = np.zeros((5, 5), bool)
    u[:, 0] = u[:, 4] = u[4] = True
    assert K.solidity(u) < 0.7 and K.dilate(square, K.FOUR).sum() == 45
    assert (K.largest(np.array([[1, 0, 1, 1]], bool)) == [[False, False, True, True]]).all()


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 2**32))
def test_assignment_is_optimal(seed):
    rng = np.random.default_rng(seed)
    n, m = rng.integers(1, 6, 2)
    w = np.round(rng.random((n, m)) * (rng.random((n, m)) < 0.7), 2)
    got = sum(w[r, c] for r, c in assign(w))
    k = int(min(n, m))
    best = max(sum(w[r, c] for r, c in zip(rows, cols, strict=True)) for rows in itertools.combinations(range(n), k) for cols in itertools.permutations(range(m), k))
    assert got == pytest.approx(best) and len({r for r, _ in assign(w)}) == len(assign(w))


def test_entangled_pieces_take_the_label_of_the_largest():
    image = np.zeros((40, 60), np.int64)
    image[5:25, 30:40] = 1
    image[5:25, 40:44] = 2  # touches 1
    image[30:35, 5:10] = 3  # alone
    out = join_entangled(image, 2, 0.45)
    assert set(np.unique(out)) == {0, 1, 3} and (out == 1).sum() == 280
    # far from the diagonal the comparison of rows with columns never sees the pair
    far = np.zeros((40, 140), np.int64)
    far[5:25, 100:110], far[5:25, 110:114] = 1, 2
    assert set(np.unique(join_entangled(far, 2, 0.45))) == {0, 1}
    assert set(np.unique(join_entangled(far, 2, 0.45, "as_written"))) == {0, 1, 2}


def line(image, width=64):
    return L.of_runs(*K.runs(image), width)


def image_of(spans, shape, width=64):
    return K.paint(shape, *L.to_runs(spans, width))


def test_repair_merges_pieces_and_relabels_single_ones():
    before, now = np.zeros((30, 30), np.int64), np.zeros((30, 30), np.int64)
    y, x = np.mgrid[:30, :30]
    blob = (y - 14) ** 2 + (x - 14) ** 2 <= 64
    before[blob] = 7
    now[blob & (x < 14)], now[blob & (x > 14)] = 3, 4
    spans, edits = repair_slice(line(before), line(now), 64, Repair())
    out = image_of(spans, now.shape)
    assert set(np.unique(out)) == {0, 7} and (out == 7).sum() > 0.95 * blob.sum() and edits[0][1].mode == "merge_union" and edits[0][1].ids.tolist() == [3, 4]
    thin = np.zeros((30, 30), np.int64)
    thin[12:17, 2:28] = 9
    spans, edits = repair_slice(line(thin), line(np.where(thin == 9, 5, 0)), 64, Repair())
    assert set(np.unique(image_of(spans, thin.shape))) == {0, 9} and edits[0][1].mode == "single_relabel"


def blocks(seed, shape=(18, 22), ids=6, hole=0.1):
    rng = np.random.default_rng(seed)
    coarse = rng.integers(0, ids + 1, (-(-shape[0] // 5), -(-shape[1] // 6)))
    big = np.repeat(np.repeat(coarse, 5, 0), 6, 1)[: shape[0], : shape[1]]
    return big * (rng.random(shape) >= hole)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.sampled_from([0.0, 0.1, 0.3]))
def test_repair_against_sets_of_pixels(seed, hole):
    rng = np.random.default_rng(seed)
    before = blocks(seed, hole=hole)
    now = np.roll(before, rng.integers(0, 2, 2), (0, 1)) if seed % 2 else blocks(seed + 1, hole=hole)
    now = rng.permutation(7)[now] * (now > 0)
    cfg = Repair(min_area=int(rng.integers(1, 9)), coverage_min=0.4, bbox_iou_min=0.2, solidity_min=0.5, eccentricity_max=0.97, closing_radius=int(rng.integers(0, 3)))
    spans, edits = repair_slice(line(before), line(now), 64, cfg)
    want, log = pixels.repair(before, now, cfg)
    assert (image_of(spans, (24, 28))[:18, :22] == want).all() and [(i, e.ids.tolist(), e.mode) for i, e in edits] == log


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 40))
def test_absorb_against_sets_of_pixels(seed, least):
    image = blocks(seed, hole=0.25)
    assert (image_of(absorbed(line(image), 64, least), image.shape) == pixels.absorb(image, least)).all()


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.sampled_from([0.3, 0.5, 0.9]))
def test_harmonize_against_sets_of_pixels(seed, least):
    rng = np.random.default_rng(seed)
    base = blocks(seed, hole=0.05)
    stack = np.stack([rng.permutation(7)[base] * (base > 0) * (rng.random(base.shape) < 0.95) if rng.random() < 0.7 else np.zeros_like(base) for _ in range(7)])
    lines, filled, renamed = [line(s) for s in stack], 0, 0
    for start in range(3):
        lines[start + 1 : start + 5], a, b = harmonize_window(lines[start : start + 5], least)
        filled, renamed = filled + a, renamed + b
    want, f, r = pixels.harmonize(stack, least)
    assert (filled, renamed) == (f, r) and all((image_of(x, base.shape) == w).all() for x, w in zip(lines, want, strict=True))


def test_absorb_and_harmonize():
    image = np.array([[1, 1, 1, 2], [1, 1, 1, 1], [0, 0, 0, 0], [3, 0, 0, 0]])
    out = image_of(absorbed(line(image), 64, 3), image.shape)
    assert out[0, 3] == 1 and out[3, 0] == 3
    slices = [np.zeros((6, 6), np.int64) for _ in range(5)]
    slices[0][1:4, 1:4] = 5
    slices[2][1:4, 1:4] = 8
    slices[4][1:4, 1:5] = 9
    rest, *more = harmonize_window([line(s) for s in slices], 0.95)
    assert more == [18, 9 + 12] and all((image_of(s, (6, 6))[1:4, 1:4] == 5).all() for s in rest)


def test_alignment():
    rng = np.random.default_rng(1)
    image = np.zeros((48, 40))
    image[10:30, 8:25] = rng.random((20, 17))
    moved = shift_image(image, 3, -4)
    assert phase_shift(image, moved) == pytest.approx((-3, 4), abs=0.2)
    assert np.allclose(shift_image(moved, -3, 4)[5:40, 5:30], image[5:40, 5:30])


@pytest.mark.parametrize("seed", range(40))
def test_boards_are_masks(seed):
    """Each step on an integer is the kernel's step on the array; hulls and moments of runs are exact."""
    rng = np.random.default_rng(seed)
    h, w, r = (int(v) for v in rng.integers((1, 1, 1), (14, 14, 4)))
    mask = np.zeros((h + 2 * r, w + 2 * r), bool)
    mask[r : r + h, r : r + w] = rng.random((h, w)) < rng.uniform(0.3, 0.9)
    width, (y, a, b, _) = mask.shape[1] + r, K.runs(mask.astype(np.int8))
    board = B.draw(y.tolist(), a.tolist(), b.tolist(), width)
    full, border = B.frame(mask.shape, width)
    same = lambda got, want: B.runs(got, width) == [tuple(v) for v in zip(*(c.tolist() for c in K.runs(want.astype(np.int8))[:3]), strict=True)]
    assert same(board, mask)
    assert same(B.drop_small(board, 4, width), K.drop_small(mask, 4))
    assert same(B.close(board, K.disk(r), full, width), K.close(mask, r))
    assert same(B.fill_holes(board, full, border, width), K.fill_holes(mask, 1))
    largest = K.largest(mask)
    assert same(B.largest(board, width), mask & False if largest is None else largest)
    if largest is not None:
        y, a, b, _ = K.runs(largest.astype(np.int8))
        assert eccentricity(list(zip(y.tolist(), a.tolist(), b.tolist(), strict=True))) == pytest.approx(K.eccentricity(largest), abs=1e-6)


@pytest.mark.parametrize("seed", range(6))
def test_small_and_large_windows_decide_alike(seed, monkeypatch):
    """A window beyond LARGEST is drawn as an array, with the same result."""
    before, now = blocks(seed), blocks(seed + 100)
    cfg = Repair(min_area=4, coverage_min=0.3, bbox_iou_min=0.1, solidity_min=0.5, eccentricity_max=0.99, closing_radius=1)
    small, edits = repair_slice(line(before), line(now), 64, cfg)
    monkeypatch.setattr(B, "LARGEST", 0)
    large, others = repair_slice(line(before), line(now), 64, cfg)
    assert [(i, e.ids.tolist(), e.fit, e.mode) for i, e in edits] == [(i, e.ids.tolist(), e.fit, e.mode) for i, e in others]
    assert all((p == q).all() for p, q in zip(small, large, strict=True))


@pytest.mark.parametrize("dtype", [np.uint8, np.uint16])
def test_png_round_trip(dtype):
    image = (np.arange(35).reshape(5, 7) * 7).astype(dtype)
    assert (codecs.read_png(codecs.write_png(image)) == image).all()
    with pytest.raises(ValueError):
        codecs.write_png(np.array([[70_000]]))


@pytest.mark.parametrize("dtype,packed", [(np.uint16, False), (np.uint32, True), (np.float32, True), (np.uint8, False)])
def test_tiff_round_trip(dtype, packed):
    stack = (np.arange(3 * 5 * 7).reshape(3, 5, 7) % 251).astype(dtype)
    data = codecs.write_tiff(stack, packed)
    assert (codecs.read_tiff(data) == stack).all() and codecs.tiff_shape(data) == (3, 5, 7)


def tagged(pages):
    """A little-endian TIFF of (tags, blocks): offsets and sizes of the blocks are filled in."""
    import struct

    out, here, last = bytearray(b"II*\0\0\0\0\0"), 4, len(pages) - 1
    for k, (tags, places, sizes, blocks) in enumerate(pages):
        at = []
        for b in blocks:
            at.append(len(out))
            out += b
        arrays = {}
        for tag, values in ((places, at), (sizes, [len(b) for b in blocks])):
            arrays[tag] = len(out)
            out += struct.pack(f"<{len(values)}I", *values)
            tags[tag] = values
        struct.pack_into("<I", out, here, len(out))
        out += struct.pack("<H", len(tags))
        for tag, v in sorted(tags.items()):
            v = v if isinstance(v, list) else [v]
            out += struct.pack("<HHII", tag, 4, len(v), v[0] if len(v) == 1 else arrays[tag])
        here = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def lzw_pack(data):
    """The encoder that belongs to the decoder."""
    table, out, bits, held, width = {bytes([k]): k for k in range(256)}, bytearray(), 0, 0, 9

    def put(code):
        nonlocal bits, held
        held, bits = (held << width) | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append((held >> bits) & 255)

    put(256)
    following, w = 258, b""
    for c in data:
        if w + bytes([c]) in table:
            w += bytes([c])
            continue
        put(table[w])
        table[w + bytes([c])] = following
        following += 1
        if following in (512, 1024, 2048):
            width += 1
        if following == 4094:
            put(256)
            table, following, width = {bytes([k]): k for k in range(256)}, 258, 9
        w = bytes([c])
    if w:
        put(table[w])
        following += 1
        if following in (512, 1024, 2048):
            width += 1
    put(257)
    if bits:
        out.append((held << (8 - bits)) & 255)
    return bytes(out)


@pytest.mark.parametrize("packing", [1, 5, 8, 32773])
@pytest.mark.parametrize("predictor", [1, 2])
def test_tiff_as_tools_write_it(packing, predictor):
    import zlib

    rng = np.random.default_rng(packing)
    image = rng.integers(0, 900, (37, 50)).astype(np.uint16) * (rng.random((37, 50)) < 0.6)

    def packed(block):
        block = block.copy()
        if predictor == 2:
            block[:, 1:] = block[:, 1:] - block[:, :-1]
        raw = block.astype("<u2").tobytes()
        runs = b"".join(bytes([len(raw[k : k + 128]) - 1]) + raw[k : k + 128] for k in range(0, len(raw), 128))
        return {1: raw, 5: lzw_pack(raw), 8: zlib.compress(raw), 32773: runs + bytes([128, 255, 7])[:1]}[packing]

    base = {256: 50, 257: 37, 258: 16, 259: packing, 317: predictor, 339: 1}
    strips = [packed(image[y : y + 10].astype(np.uint16)) for y in range(0, 37, 10)]
    padded = np.zeros((48, 64), np.uint16)
    padded[:37, :50] = image
    tiles = [packed(padded[y : y + 16, x : x + 16]) for y in range(0, 48, 16) for x in range(0, 64, 16)]
    data = tagged([(base | {278: 10}, 273, 279, strips), (base | {322: 16, 323: 16}, 324, 325, tiles)])
    assert (codecs.read_tiff(data) == image).all() and codecs.tiff_shape(data) == (2, 37, 50)


def test_packbits():
    assert codecs.packbits(bytes([2, 1, 2, 3, 254, 7, 128, 0, 9])) == bytes([1, 2, 3, 7, 7, 7, 9])


@pytest.mark.parametrize("big", [False, True])
def test_big_tiff(big):
    stack = np.arange(3 * 5 * 7).reshape(3, 5, 7).astype(np.uint32)
    assert (codecs.read_tiff(codecs.write_tiff(stack, True, big)) == stack).all()


@pytest.mark.parametrize("seed", range(20))
def test_repair_of_masks_and_of_spans_decide_alike(seed):
    """A slice held as one integer an id is repaired as one held as spans, with the same edits."""
    from lamina.operators.postproc import Frame, repair_masks

    before, now = blocks(seed), blocks(seed + 100, hole=0.2)
    cfg = Repair(min_area=4, coverage_min=0.3, bbox_iou_min=0.1, solidity_min=0.5, eccentricity_max=0.99, closing_radius=1 + seed % 2, fill_holes=seed % 3 > 0)
    spans, edits = repair_slice(line(before), line(now), 64, cfg)
    masks = lambda image: {i: sum(1 << y * 70 + x for y, x in p) for i, p in pixels.by_id(image).items()}
    got, others = repair_masks(masks(before), masks(now), Frame(64, 70), cfg)
    assert got == masks(image_of(spans, now.shape))
    assert [(i, e.ids.tolist(), e.mode) for i, e in edits] == [(i, e.ids.tolist(), e.mode) for i, e in others]
    assert all(a.fit == pytest.approx(b.fit) for (_, a), (_, b) in zip(edits, others, strict=True))


def test_background_distances_of_a_whole_slice():
    """Each pixel's distance to the foreground, where it lies within reach."""
    from lamina.operators.clean import _background_distance, _median

    image = np.random.default_rng(7).integers(0, 12, (9, 11)) // 11
    got = _background_distance(image, 2)
    on = np.argwhere(image)
    for p in np.ndindex(image.shape):
        near = [np.hypot(*(q - p)) for q in on if np.abs(q - p).max() <= 2]
        assert got[p] == (min(near) if near else np.inf)
    assert _median(np.array([3.0, 1.0, 2.0])) == 2 and _median(np.array([4.0, 1.0, 2.0, 3.0])) == 2.5


@pytest.mark.parametrize("seed", range(12))
def test_shapes_are_measured_by_rows_as_by_runs(seed, monkeypatch):
    """Moments, boxes and solidity from rows of bits equal those of the runs; a full box needs no hull."""
    from lamina.operators import postproc

    rng = np.random.default_rng(seed)
    image = rng.random((7, 9)) < (0.55, 0.75, 0.95, 1.0)[seed % 4]
    image[3] = True
    side = (64, 512)[seed % 2]
    mask = sum(1 << (y + 5) * side + x + 11 for y, x in np.argwhere(image).tolist())
    cut = postproc.Cut.of(mask, side)
    top, left = np.argwhere(image).min(0).tolist()
    assert (cut.y, cut.x) == (5 + top, 11 + left) and cut.bits << cut.y * side + cut.x == mask
    region = B.runs(B.largest(mask, side), side)
    got = postproc._largest(cut.bits, side)
    assert (got.n, got.sy + got.n * cut.y, got.sx + 2 * got.n * cut.x) == tuple(sum(v) for v in zip(*((b - a, y * (b - a), (a + b - 1) * (b - a)) for y, a, b in region), strict=True))
    assert got.moved(cut.y, cut.x) == (region[0][0], min(r[1] for r in region), region[-1][0] + 1, max(r[2] for r in region))
    assert sorted(zip(*(postproc._runs(cut.bits, side) + [[cut.y], [cut.x], [cut.x]]).tolist(), strict=True)) == B.runs(mask, side)
    cfg = Repair(min_area=1, closing_radius=0, fill_holes=False, solidity_min=(0.8, 0.97)[seed % 2], eccentricity_max=0.9)
    hulls = []
    monkeypatch.setattr(postproc.K, "hull_of_runs", lambda rows, f=K.hull_of_runs: hulls.append(f(rows)) or hulls[-1])
    tidied = postproc._tidied.__wrapped__(cut.bits, side, 0, 0, cfg)
    good = tidied.good
    assert not (image.all() and hulls)
    assert good == (eccentricity(region) <= 0.9 and sum(b - a for _, a, b in region) / K.hull_of_runs(region) >= cfg.solidity_min)
