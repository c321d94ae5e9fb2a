"""Duplicate groups row by row, as plain loops: what the parallel rounds have to equal."""

from __future__ import annotations


def grouped(ids: list[int], norm: dict, base: dict, isbn: dict, fuzzy: dict[int, list[int]], contained: dict[int, list[int]] | None) -> list[tuple[str, list[int]]]:
    """The groups of one owner's rows, in order: equal normalised titles; of the rest equal base titles, then equal
    isbns; then stars of similar titles around each row that no star has used yet (it may belong to a group already,
    but no pair is made twice); then, if wanted, stars of contained titles, which join the first group they touch."""
    groups: list[tuple[str, list[int]]] = []
    of: dict[int, set[int]] = {i: set() for i in ids}  # the places of the groups that hold a row

    def add(name: str, members: list[int]) -> None:
        for i in members:
            of[i].add(len(groups))
        groups.append((name, members))

    taken: set[int] = set()
    for kind, key in (("exact", norm), ("base", base), ("isbn", isbn)):
        by: dict = {}
        for i in ids:
            if key[i] and i not in taken:
                by.setdefault(key[i], []).append(i)
        for k, members in by.items():
            if len(members) > 1:
                add(f"{kind}:{k}", members)
        taken |= {i for _, members in groups for i in members}

    used: set[int] = set()
    for i in ids:
        if i in used:
            continue
        star = [i] + [j for j in fuzzy.get(i, ()) if j not in used and of[i].isdisjoint(of[j])]
        if len(star) > 1:
            used.update(star)
            add(f"fuzzy:{i}", star)
    for i in ids if contained is not None else ():
        if i in used:
            continue
        star = [i] + [j for j in contained.get(i, ()) if j not in used and of[i].isdisjoint(of[j])]
        used.update(star[1:])
        if len(star) > 1:
            touched = min((g for j in star for g in of[j]), default=None)
            if touched is None:
                add(f"contained:{i}", star)
            else:
                groups[touched][1].extend(j for j in star if touched not in of[j])
                for j in star:
                    of[j].add(touched)
    return groups
