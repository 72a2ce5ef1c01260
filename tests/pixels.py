"""The order-dependent kernels on sets of pixels, as slow and plain as can be."""

from collections import Counter, defaultdict

import numpy as np

from lamina.functions import kernels as K

CROSS = ((-1, 0), (0, -1), (0, 1), (1, 0))


def by_id(image):
    out = defaultdict(set)
    for y, x in np.argwhere(image).tolist():
        out[int(image[y, x])].add((y, x))
    return out


def to_image(owner, shape):
    out = np.zeros(shape, np.int64)
    for (y, x), i in owner.items():
        out[y, x] = i
    return out


def split(pixels):
    """4-connected pieces, by their first pixel in raster order."""
    left, out = set(pixels), []
    for p in sorted(pixels):
        if p in left:
            left.discard(p)
            piece, todo = {p}, [p]
            while todo:
                y, x = todo.pop()
                near = {(y + a, x + b) for a, b in CROSS} & left
                left -= near
                piece |= near
                todo += near
            out.append(piece)
    return out


def box(pixels):
    y, x = zip(*pixels, strict=True)
    return min(y), min(x), max(y) + 1, max(x) + 1


def centre(pixels):
    return tuple(np.mean(sorted(pixels), axis=0))


def mask(pixels):
    a, b, c, d = box(pixels)
    out = np.zeros((c - a, d - b), bool)
    for y, x in pixels:
        out[y - a, x - b] = True
    return out


def tidy(pixels, cfg):
    big = set().union(*[p for p in split(pixels) if len(p) >= cfg.min_area])
    disk = K.disk(cfg.closing_radius)
    fat = {(y + a, x + b) for y, x in big for a, b in disk if y + a >= 0 and x + b >= 0}
    if cfg.closing_radius > 0:
        big = {(y, x) for y, x in fat if all((y + a, x + b) in fat or y + a < 0 or x + b < 0 for a, b in disk)}
    if cfg.fill_holes and big:
        a, b, c, d = box(big)
        free = {(y, x) for y in range(a - 1, c + 1) for x in range(b - 1, d + 1)} - big
        outside = next(p for p in split(free) if (a - 1, b - 1) in p)
        big |= free - outside
    return big


def repair(before, now, cfg):
    """(image, [(id, ids, mode)])."""
    owner = {p: i for i, ps in by_id(now).items() for p in ps}
    used, log = set(), []
    for i, whole in sorted(by_id(before).items()):
        region = max(split(whole), key=len)
        if len(region) < cfg.min_area:
            continue
        votes = Counter(owner[p] for p in whole if p in owner)
        ids = {j for j, n in votes.items() if n >= cfg.min_overlap_pixels}
        if not ids:
            a, b, c, d = box(region)
            m = cfg.bbox_margin
            ids = {j for (y, x), j in owner.items() if max(0, a - m) <= y < c + m and max(0, b - m) <= x < d + m}
        ids = sorted(ids - used)
        raw = {p for p, j in owner.items() if j in ids}
        union = tidy(raw, cfg) if raw else set()
        if not union:
            continue

        def fits(pixels, cover, overlap, region=region, whole=whole):
            top = max(split(pixels), key=len)
            near = np.hypot(*np.subtract(centre(region), centre(top))) <= cfg.centroid_dist_max
            return len(whole & pixels) / len(whole) >= cover and near and K.box_overlap(box(region), box(top)) >= overlap

        top = mask(max(split(union), key=len))
        shapely = top.sum() >= cfg.min_area and K.solidity(top) >= cfg.solidity_min and K.eccentricity(top) <= cfg.eccentricity_max
        if fits(union, cfg.coverage_min, cfg.bbox_iou_min) and shapely:
            owner = {p: j for p, j in owner.items() if j not in ids} | dict.fromkeys(union, i)
            log.append((i, ids, "merge_union"))
        elif len(ids) == 1 and fits(raw, cfg.single_coverage_min, cfg.single_bbox_iou_min):
            owner |= dict.fromkeys(raw, i)
            log.append((i, ids, "single_relabel"))
        else:
            continue
        used |= set(ids)
    return to_image(owner, now.shape), log


def absorb(image, least):
    owner = {p: i for i, ps in by_id(image).items() for p in ps}
    for i in sorted(set(owner.values())):
        for piece in split({p for p, j in owner.items() if j == i}):
            if len(piece) < least:
                ring = {(y + a, x + b) for y, x in piece for a, b in CROSS} - piece
                votes = Counter(owner[p] for p in ring if owner.get(p, i) != i)
                if votes:
                    owner |= dict.fromkeys(piece, min(votes, key=lambda j: (-votes[j], j)))
    return to_image(owner, image.shape)


def harmonize(stack, least):
    """(stack, filled, renamed) by windows of five slices."""
    stack, filled, renamed = stack.copy(), 0, 0
    for start in range(len(stack) - 4):
        for i, pixels in sorted(by_id(stack[start]).items()):
            at, gaps = tuple(np.array(sorted(pixels)).T), []
            for k in range(start + 1, start + 5):
                votes = Counter(v for v in stack[k][at].tolist() if v)
                if not votes:
                    gaps.append(k)
                    continue
                best = min(votes, key=lambda j: (-votes[j], j))
                if votes[best] / len(pixels) >= least:
                    for g in gaps:
                        filled += int((stack[g][at] == 0).sum())
                        stack[g][at] = np.where(stack[g][at] == 0, i, stack[g][at])
                    gaps = []
                    if best != i:
                        renamed += int((stack[k] == best).sum())
                        stack[k][stack[k] == best] = i
    return stack, filled, renamed


def repaired(stack, cfg):
    """The stack seen from the side, chunk by chunk, seams, then back; turned back. With both logs."""
    side = np.ascontiguousarray(stack.transpose(2, 0, 1))
    n, log = len(side), []
    pair = lambda a, b, keep=True: side.__setitem__(b, _logged(side[a], side[b], cfg, log if keep else None, b))
    for low in range(0, n, cfg.chunk_size):
        for z in range(low + 1, min(n, low + cfg.chunk_size)):
            pair(z - 1, z)
    for z in range(cfg.chunk_size, n, cfg.chunk_size):
        pair(z - 1, z, False)
    if cfg.run_backward_pass:
        for z in range(n - 2, -1, -1):
            pair(z + 1, z)
    return side.transpose(1, 2, 0), log


def _logged(before, now, cfg, log, z):
    out, edits = repair(before, now, cfg)
    if log is not None:
        log += [(z, i, ",".join(map(str, ids)), mode) for i, ids, mode in edits]
    return out


AROUND = tuple((a, b) for a in (-1, 0, 1) for b in (-1, 0, 1))


def filled(image, least):
    """Each id's large pieces with the holes that eight-connected background can't reach; the highest id wins."""
    owner = {}
    for i, owned in sorted(by_id(image).items()):
        big = set().union(*[p for p in split(owned) if len(p) >= least])
        if big:
            a, b, c, d = box(big)
            free = {(y, x) for y in range(a - 1, c + 1) for x in range(b - 1, d + 1)} - big
            todo = [(a - 1, b - 1)]
            while todo:
                y, x = todo.pop()
                near = {(y + p, x + q) for p, q in AROUND} & free
                free -= near
                todo += near
            owner |= dict.fromkeys(big | free, i)
    return to_image(owner, image.shape)


def entangled(image, r, least):
    """Pieces that fit together take the label of the largest."""
    h, w = image.shape
    inside = lambda ps: {(y, x) for y, x in ps if 0 <= y < h and 0 <= x < w}
    grow = lambda ps, by: inside({(y + a, x + b) for y, x in ps for a, b in by})
    owner = {p: i for i, ps in by_id(image).items() for p in ps}
    items = [(i, p) for i, ps in sorted(by_id(image).items()) for p in split(ps)]
    fat, near = [grow(p, K.disk(r)) for _, p in items], [grow(p, AROUND) for _, p in items]
    wide = []
    for _, p in items:
        a, b, c, d = box(p)
        wide.append((max(0, a - r), max(0, b - r), min(h, c + r), min(w, d + r)))
    group = list(range(len(items)))
    head = list(range(len(items)))

    def gap(p):
        return min(np.hypot(y - p[0], x - p[1]) for y, x in {(p[0] + a, p[1] + b) for a in range(-r, r + 1) for b in range(-r, r + 1)} if (y, x) in owner)

    def score(i, j):
        both = fat[i] & fat[j]
        touch = len(items[i][1] & near[j]) / (len(near[i] - items[i][1]) + 1)
        p, q = (np.array(sorted(items[k][1])) for k in (i, j))
        apart = np.sqrt(((p[:, None] - q[None]) ** 2).sum(2).min())
        corridor = [gap(c) for c in both if c not in owner]
        return 0.2 * len(both) / len(fat[i] | fat[j]) + 0.8 * touch + 0.5 * np.exp(-apart / 2) - 0.25 * (np.median(corridor) if corridor else 0) / (r + 1e-6)

    for i in range(len(items)):
        found = None
        for j in range(len(items)):
            u, v = wide[i], wide[j]
            if items[i][0] == items[j][0] or group[i] == group[j] or not (u[0] < v[2] and v[0] < u[2] and u[1] < v[3] and v[1] < u[3]):
                continue
            s = score(i, j)
            if found is None or s > found[0]:
                found = s, j
        if found and found[0] >= least:
            a, b = group[i], group[found[1]]
            if len(items[head[a]][1]) < len(items[head[b]][1]):
                a, b = b, a
            group = [a if g == b else g for g in group]
    out = {}
    for g in set(group):
        mine = [k for k in range(len(items)) if group[k] == g]
        top = max(mine, key=lambda k: (len(items[k][1]), -k))
        for k in mine:
            out |= dict.fromkeys(items[k][1], items[top][0])
    return to_image(out, image.shape)
