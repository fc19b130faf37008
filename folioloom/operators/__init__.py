"""DataFrame transforms over elements and chunks."""
