"""kvern.streaming"""
