"""Part of the deal-flow library; see the modules."""
