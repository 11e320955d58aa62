"""Analytics over item baskets and the texts they come from, as DataFrame operators."""
