"""Analytics over documents and conversations as DataFrame transforms."""
