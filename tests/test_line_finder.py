import numpy as np

from strokelake.operators import raster


def search(points, votes_needed, length_needed, max_gap):
    turns = np.radians(np.arange(180))
    normals = np.stack([np.cos(turns), np.sin(turns)])
    rho = np.floor(points @ normals + 0.5).astype(np.int32)
    return rho, normals, raster._longest_run(points, rho, normals, votes_needed, length_needed, max_gap)


def every_run(points, rho, normals, votes_needed, max_gap):
    """Longest run with enough pixels over every cell with enough votes, one by one."""
    longest = 0.0
    for turn in range(180):
        levels, counts = np.unique(rho[:, turn], return_counts=True)
        for level in levels[counts >= votes_needed]:
            on = points[np.abs(rho[:, turn] - level) <= 3]
            along = on @ np.array([-normals[1, turn], normals[0, turn]])
            order = np.argsort(along, kind="stable")
            for run in np.split(order, np.flatnonzero(np.diff(along[order]) > max_gap) + 1):
                if len(run) >= votes_needed:
                    longest = max(longest, float(np.hypot(*(on[run[-1]] - on[run[0]]))))
    return longest


def test_longest_run_in_a_weak_cell():
    block = np.array([(x, y) for x in range(60) for y in range(60)], float)
    line = np.array([(x, 200) for x in range(100, 400, 6)], float)
    points = np.concatenate([block, line])
    rho, normals, best = search(points, 40, 50, 10)
    found = float(np.hypot(best[2] - best[0], best[3] - best[1]))
    assert found == every_run(points, rho, normals, 40, 10) and found > 290


def test_second_run_of_a_cell():
    sparse = np.array([(x, 100) for x in range(0, 200, 10)], float)
    full = np.array([(x, 100) for x in range(300, 400)], float)
    points = np.concatenate([sparse, full])
    rho, normals, best = search(points, 60, 50, 15)
    found = float(np.hypot(best[2] - best[0], best[3] - best[1]))
    assert best[:2] != (0, 100) and found == every_run(points, rho, normals, 60, 15)
