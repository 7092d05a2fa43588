"""Reports as DataFrame builders."""
