"""Rule packs: what a call to a known API says about its caller. Data only; ``plans/relations.py`` applies them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Pack, API, predicate, object, settled (whether the call alone settles what happens at run time).
#: The FromISR form of an API says the same in interrupt context, and is not listed.
RULES = [
    ("scheduler", "taskENTER_CRITICAL", "enters_critical_section", "critical_section", True),
    ("scheduler", "taskEXIT_CRITICAL", "exits_critical_section", "critical_section", True),
    ("scheduler", "vTaskSuspendAll", "suspends_scheduler", "scheduler", True),
    ("scheduler", "xTaskResumeAll", "resumes_scheduler", "scheduler", True),
    ("scheduler", "portYIELD_FROM_ISR", "requests_context_switch", "context_switch", False),
    ("scheduler", "portYIELD_WITHIN_API", "requests_context_switch", "context_switch", False),
    ("scheduler", "portYIELD", "requests_context_switch", "context_switch", False),
    ("scheduler", "taskYIELD", "requests_context_switch", "context_switch", False),
    ("scheduler", "portSET_INTERRUPT_MASK_FROM_ISR", "masks_interrupts_from_isr", "interrupt_mask", False),
    ("scheduler", "portCLEAR_INTERRUPT_MASK_FROM_ISR", "clears_interrupt_mask_from_isr", "interrupt_mask", False),
    ("task_state", "prvAddTaskToReadyList", "moves_task_to_ready_list", "ready_list", False),
    ("task_state", "vTaskPlaceOnEventList", "blocks_task_on_event_list", "event_list", False),
    ("task_state", "vTaskPlaceOnEventListRestricted", "blocks_task_on_event_list", "event_list", False),
    ("task_state", "xTaskRemoveFromEventList", "unblocks_task_from_event_list", "event_list", False),
    ("task_state", "prvAddCurrentTaskToDelayedList", "moves_task_to_delayed_list", "delayed_list", False),
    ("task_state", "uxListRemove", "removes_task_from_list", "list", False),
    ("heap", "pvPortMalloc", "allocates_heap_memory", "heap_memory", False),
    ("heap", "vPortFree", "frees_heap_memory", "heap_memory", False),
    ("heap", "prvInsertBlockIntoFreeList", "coalesces_free_blocks", "free_block_list", False),
    ("heap", "vPortDefineHeapRegions", "uses_multiple_heap_regions", "heap_regions", False),
    ("hook", "vApplicationMallocFailedHook", "invokes_application_hook", "malloc_failed_hook", False),
    ("hook", "vApplicationStackOverflowHook", "invokes_application_hook", "stack_overflow_hook", False),
    ("hook", "vApplicationIdleHook", "invokes_application_hook", "idle_hook", False),
    ("hook", "vApplicationTickHook", "invokes_application_hook", "tick_hook", False),
    ("hook", "vApplicationDaemonTaskStartupHook", "invokes_application_hook", "daemon_task_startup_hook", False),
    ("hook", "configASSERT", "invokes_assert_handler", "assert_handler", False),
    ("kernel_object", "xStreamBufferSend", "sends_to_stream_buffer", "stream_buffer", False),
    ("kernel_object", "xStreamBufferReceive", "receives_from_stream_buffer", "stream_buffer", False),
    ("kernel_object", "xMessageBufferSend", "sends_to_message_buffer", "message_buffer", False),
    ("kernel_object", "xMessageBufferReceive", "receives_from_message_buffer", "message_buffer", False),
    ("kernel_object", "xEventGroupSetBits", "sets_event_bits", "event_group", False),
    ("kernel_object", "xEventGroupClearBits", "clears_event_bits", "event_group", False),
    ("kernel_object", "xEventGroupWaitBits", "waits_for_event_bits", "event_group", False),
    ("kernel_object", "xEventGroupSync", "syncs_event_bits", "event_group", False),
    ("kernel_object", "xTaskGenericNotify", "notifies_task", "task_notification", False),
    ("kernel_object", "ulTaskGenericNotifyTake", "waits_for_task_notification", "task_notification", False),
    ("kernel_object", "xSemaphoreGive", "gives_semaphore", "semaphore", False),
    ("kernel_object", "xSemaphoreTake", "takes_semaphore", "semaphore", False),
    ("kernel_object", "xSemaphoreCreateBinary", "creates_semaphore", "semaphore", False),
    ("kernel_object", "xSemaphoreGiveRecursive", "gives_mutex", "mutex", False),
    ("kernel_object", "xSemaphoreTakeRecursive", "takes_mutex", "mutex", False),
    ("kernel_object", "xSemaphoreCreateMutex", "creates_mutex", "mutex", False),
    ("file", "CreateFile", "opens_file", "file", True),
    ("file", "GetFileSize", "reads_file_size", "file", True),
    ("file", "CreateFileMapping", "maps_file_buffer", "file", True),
    ("file", "MapViewOfFile", "maps_file_buffer", "file", True),
    ("file", "fopen", "opens_file", "file", True),
    ("file", "fclose", "closes_file", "file", True),
]


def rules(spark: SparkSession) -> DataFrame:
    """pack, api, predicate, object, settled."""
    return spark.createDataFrame(RULES, "pack string, api string, predicate string, object string, settled boolean")
