from .raw import read_neighbours, read_points, write_neighbours, write_points
from .sinks import node_lines, write_cells, write_nodes, write_table

__all__ = ["node_lines", "read_neighbours", "read_points", "write_cells", "write_neighbours", "write_nodes", "write_points", "write_table"]
