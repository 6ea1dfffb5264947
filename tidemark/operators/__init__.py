"""Dataflow steps from filed positions to one mark for each loan and quarter."""
