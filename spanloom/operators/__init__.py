"""Relational operators over intervals, boxes, tracks and queues."""
